"""How the driver tables stand in for the knowledge base, the logs and the tests.

Every view is a pure projection / join of the given tables, so each job's work
grows with them.  The same definitions are written in DuckDB SQL in
``quarry.plans.catalog`` for the oracle check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.tables import spread, table

NL = "\n"


def doc_path():
    """Knowledge-base path of a document: kb/<source>/<lang>/doc-<id>.md"""
    return F.concat(F.lit("kb/"), F.col("source"), F.lit("/"), F.col("lang"),
                    F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".md"))


def vector_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk per document, vector from ``embeddings`` (null when absent)."""
    docs = table(spark, sf_dir, "documents")
    emb = table(spark, sf_dir, "embeddings")
    return (docs.join(emb, docs.doc_id == emb.vec_id, "left")
            .select(doc_path().alias("source_path"), F.lit(0).alias("chunk_index"),
                    F.col("text").alias("content"), F.col("embedding")))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored embedding used as a query vector."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")


def line_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical/hybrid index: every line of every document is one chunk.

    Only a corpus of few row groups is dealt out anew, so that the explode and the embedding run in
    parallel; a large one is read where it lies, since the index is derived again by each pass over it."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))
    return (docs.select(doc_path().alias("source_path"),
                        F.posexplode(F.split(F.col("text"), NL)).alias("chunk_index", "content"))
            .select("source_path", F.col("chunk_index").cast("int"), "content"))


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as free-text search queries (whole texts)."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"),
                                                    F.col("text").alias("query"))


# --- usage log ----------------------------------------------------------------------
# Per-model pricing configuration used by the registered usage jobs; model m3 is
# left unpriced so it falls back to the default rates.
PRICING_JSON = ('{"m0": {"input": 2, "cached_input": 0.2, "output": 8}, '
                '"m1": {"input": 1.25, "cached_input": 0.125, "output": 10}, '
                '"m2": {"input": 0.15, "cached_input": 0.075, "output": 0.6}}')
USAGE_RANGE = ("2024-01-01 00:00:00", "2024-02-01 00:00:00")


def usage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw model-response log: one row per event, usage as JSON text.

    error events carry no usage, view events omit total_tokens, signup events
    send total_tokens = null (the three missing-value rules of the recorder).
    """
    return usage_rows(table(spark, sf_dir, "events"))


def usage_rows(ev: DataFrame) -> DataFrame:
    """Projection of event rows (batch or stream) to response-log rows."""
    it = F.floor(F.col("value") * 10).cast("long").cast("string")
    ot = F.floor(F.col("value") * 3).cast("long").cast("string")
    tt = (F.floor(F.col("value") * 10).cast("long") + F.floor(F.col("value") * 3).cast("long")).cast("string")
    k = F.get_json_object("props", "$.k").cast("long").cast("string")
    details = F.concat(F.lit(', "input_tokens_details": {"cached_tokens": '), k, F.lit("}}"))
    head = F.concat(F.lit('{"input_tokens": '), it, F.lit(', "output_tokens": '), ot)
    usage = (F.when(F.col("event_type") == "error", F.lit(None).cast("string"))
             .when(F.col("event_type") == "view", F.concat(head, details))
             .when(F.col("event_type") == "signup", F.concat(head, F.lit(', "total_tokens": null'), details))
             .otherwise(F.concat(head, F.lit(', "total_tokens": '), tt, details)))
    return ev.select(F.concat(F.lit("resp-"), F.col("event_id").cast("string")).alias("response_id"),
                     F.col("ts").alias("created_at"), F.col("event_type").alias("operation"),
                     F.concat(F.lit("m"), F.pmod(F.col("user_id"), F.lit(4)).cast("string")).alias("model"),
                     usage.alias("usage_json"))


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.operators.accounting import pricing_table, usage_cost
    return usage_cost(usage_log(spark, sf_dir), pricing_table(spark, PRICING_JSON))


# --- test sessions ------------------------------------------------------------------
SESSION_RANGE = ("1995-01-01 00:00:00", "2002-01-01 00:00:00")
QUESTION_TYPES = ("short_answer", "single_choice", "multiple_choice")
ANSWER_ORDER = ["answered_at", "l_partkey", "l_suppkey", "l_extendedprice"]


def session_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as test starts (one start event per session)."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"),
                    F.concat(F.lit("anon-"), F.col("o_custkey").cast("string")).alias("anonymous_session_id"),
                    F.col("o_orderdate").alias("started_at"),
                    F.array("o_orderstatus", "o_orderpriority").alias("topics"),
                    F.lit(7).alias("requested_questions"))


def answer_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as answer writes; (session, question) repeats, so first-write-wins matters."""
    return answer_rows(spread(table(spark, sf_dir, "lineitem")))


def answer_rows(li: DataFrame) -> DataFrame:
    """Projection of line items (batch or stream) to answer writes."""
    assigned = F.col("l_quantity").cast("int") % 5 + 1
    correct = F.col("l_returnflag") == "R"
    return li.select(
        F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("question_number"),
        F.element_at(F.array(*[F.lit(t) for t in QUESTION_TYPES]),
                     (F.pmod(F.col("l_partkey"), F.lit(3)) + 1).cast("int")).alias("question_type"),
        assigned.alias("assigned_difficulty"),
        F.greatest(F.lit(1), F.least(F.lit(5), assigned + F.when(correct, 1).otherwise(-1))).alias("next_difficulty"),
        correct.alias("is_correct"), F.col("l_shipdate").alias("answered_at"),
        "l_partkey", "l_suppkey", "l_extendedprice")


def finish_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished line items as finish calls; several per session, the first one wins."""
    li = spread(table(spark, sf_dir, "lineitem"))
    return (li.where(F.col("l_linestatus") == "F")
            .select(F.col("l_orderkey").alias("session_id"), F.col("l_shipdate").alias("finished_at"),
                    (F.col("l_returnflag") != "N").alias("completed"),
                    (F.col("l_linenumber") < 4).alias("ended_early"),
                    F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("tiebreak")))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.operators.sessions import answers_first_wins
    return answers_first_wins(answer_events(spark, sf_dir), ANSWER_ORDER)


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.operators.sessions import sessions_build
    return sessions_build(session_starts(spark, sf_dir), answers(spark, sf_dir), finish_events(spark, sf_dir))


# --- hybrid search --------------------------------------------------------------------
def hybrid_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line chunks with hashed term-count vectors (the default embedder)."""
    from quarry.operators.embedding import embed_hashing
    return embed_hashing(line_index(spark, sf_dir), "content")


def hybrid_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.operators.embedding import embed_hashing
    return embed_hashing(search_queries(spark, sf_dir), "query")


# --- Markdown corpus ------------------------------------------------------------------
def markdown_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a Markdown file: '# source', '## lang', then its text in one of
    four layouts chosen by doc_id mod 4 (plain lines; paragraphs; a loose list; a fenced
    block followed by a rule, a sub-heading and a low-information line)."""
    return markdown_rows(table(spark, sf_dir, "documents"))


def markdown_rows(docs: DataFrame) -> DataFrame:
    """Projection of document rows (batch or stream) to Markdown files."""
    text = F.col("text")
    paragraphs = F.replace(text, F.lit(NL), F.lit(NL + NL))
    loose_list = F.concat(F.lit("- "), F.replace(text, F.lit(NL), F.lit(NL + NL + "- ")))
    fenced = F.concat(F.lit("```text" + NL), paragraphs, F.lit(NL + "```" + NL + NL + "***" + NL + NL
                                                              + "### end" + NL + NL + "where"))
    body = (F.when(F.col("doc_id") % 4 == 0, text).when(F.col("doc_id") % 4 == 1, paragraphs)
            .when(F.col("doc_id") % 4 == 2, loose_list).otherwise(fenced))
    content = F.concat(F.lit("# "), F.col("source"), F.lit(NL + NL + "## "), F.col("lang"), F.lit(NL + NL), body)
    return docs.select(doc_path().alias("source_path"), content.alias("content"))


# --- index refresh ---------------------------------------------------------------------
REFRESH_NOW = "2024-01-31 00:00:00"
REFRESH_DAYS = 3


def kb_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown files with a modification time spread over January 2024."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    mtime = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        F.pmod(F.col("doc_id"), F.lit(30)).cast("int"))
    meta = docs.select(doc_path().alias("source_path"), mtime.alias("modified_at"))
    return markdown_files(spark, sf_dir).join(meta, "source_path")


def existing_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index before the refresh: line chunks of the documents that carry labels."""
    labelled = table(spark, sf_dir, "labels").select("doc_id")
    docs = table(spark, sf_dir, "documents").join(labelled, "doc_id", "left_semi")
    return (docs.select(doc_path().alias("source_path"),
                        F.posexplode(F.split(F.col("text"), NL)).alias("chunk_index", "content"))
            .select("source_path", F.col("chunk_index").cast("int"), "content"))


# --- question bank ---------------------------------------------------------------------
BANK_THRESHOLD = 0.95  # fixed value: the default similarity threshold


def question_records(spark: SparkSession, sf_dir: str, how: str | None = None) -> DataFrame:
    """Every document, or those with a label (``how`` left_semi) or without one (left_anti), as a generated question record:
    the whole text is the question, its vector that of the question text.  Only a text without a token is never a duplicate."""
    from quarry.operators.bank import QUESTION_TYPES
    from quarry.operators.embedding import embed_hashing
    from quarry.session import bounded
    docs = spread(table(spark, sf_dir, "documents"))
    if how:  # the ids are sent to the texts, if a task can hold them, and vectors made for the texts that stay
        docs = docs.join(bounded(table(spark, sf_dir, "labels").select("doc_id").distinct()), "doc_id", how)
    docs = embed_hashing(docs, "text")
    qtype = F.element_at(F.array(*[F.lit(t) for t in QUESTION_TYPES]),
                         (F.pmod(F.col("doc_id"), F.lit(3)) + 1).cast("int"))
    options = F.when(qtype == "short_answer", F.array().cast("array<string>")) \
        .otherwise(F.array(F.col("source"), F.col("lang"), F.concat_ws("-", "source", "lang")))
    expected = (F.when(qtype == "short_answer", F.array(F.col("lang")))
                .when(qtype == "single_choice", F.array(F.col("source")))
                .otherwise(F.array(F.col("source"), F.col("lang"))))
    question = F.struct(qtype.alias("question_type"), F.col("text").alias("question"),
                        options.alias("options"), expected.alias("expected_answer"),
                        F.concat(F.lit("from "), F.col("source")).alias("explanation"))
    return docs.select(F.col("doc_id").alias("candidate_id"), question.alias("question"),
                       (F.pmod(F.col("doc_id"), F.lit(5)) + 1).cast("int").alias("generation_difficulty"),
                       F.array(doc_path(), doc_path(), F.lit("")).alias("source_paths"), "embedding")


def question_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored bank: records of labelled documents, stamped one minute apart."""
    from quarry.operators.bank import normalize_records
    recs = normalize_records(question_records(spark, sf_dir, "left_semi"))
    return recs.select(F.col("candidate_id").alias("id"), "question_type", "question_text", "options",
                       "correct_answer", "explanation", F.col("paths").alias("source_paths"),
                       F.col("store_difficulty").alias("difficulty"), "embedding",
                       (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
                        + F.make_dt_interval(F.lit(0), F.lit(0), F.col("candidate_id").cast("int")))
                       .alias("created_at"))


def bank_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new batch to store: records of the unlabelled documents, in doc order."""
    return question_records(spark, sf_dir, "left_anti")


# --- generation attempts and judge outputs ----------------------------------------------
ATTEMPTS = 3


def generation_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw model outputs for three attempts per labelled document (a question slot).

    (doc_id + attempt) mod 10 picks the shape: 0 blank, 1 broken JSON, 2 a JSON
    array, 3 an unsupported type, 4 a choice question with one option, otherwise
    a well-formed question whose text is the document.  Judge scores derive from
    the labels; some are out of range (mod 13) or booleans (mod 17).
    """
    from quarry.operators.bank import QUESTION_TYPES
    docs = spread(table(spark, sf_dir, "documents")).join(table(spark, sf_dir, "labels"), "doc_id")
    a = docs.select("*", F.explode(F.sequence(F.lit(1), F.lit(ATTEMPTS))).alias("attempt_number"))
    k = F.pmod(F.col("doc_id") + F.col("attempt_number"), F.lit(10))
    qtype = F.element_at(F.array(*[F.lit(t) for t in QUESTION_TYPES]),
                         (F.pmod(F.col("doc_id"), F.lit(3)) + 1).cast("int"))
    qtype = F.when(k == 3, F.lit("essay")).when(k == 4, F.lit("multiple_choice")).otherwise(qtype)
    options = (F.when(k == 4, F.array(F.col("source")))
               .when(qtype == "short_answer", F.array().cast("array<string>"))
               .otherwise(F.array(F.col("source"), F.col("lang"), F.concat_ws("-", "source", "lang"))))
    expected = (F.when(qtype == "short_answer", F.array(F.col("lang")))
                .when(qtype == "single_choice", F.array(F.col("source")))
                .otherwise(F.array(F.col("source"), F.col("lang"))))
    question = F.to_json(F.struct(qtype.alias("question_type"), F.col("text").alias("question"),
                                  options.alias("options"), expected.alias("expected_answer"),
                                  F.concat(F.lit("from "), F.col("source")).alias("explanation")))
    output = (F.when(k == 0, F.lit("")).when(k == 1, F.lit('{"question": '))
              .when(k == 2, F.lit("[1, 2]")).otherwise(question))
    d, n = F.col("doc_id"), F.col("attempt_number")
    g = F.when(F.pmod(d + n, F.lit(13)) == 0, F.lit(6)).otherwise(F.pmod(d + 2 * n, F.lit(5)) + 1)
    c = F.least(F.lit(5), F.lit(2) + F.col("quality") * 2 + F.pmod(n, F.lit(2)))
    cl = F.lit(5) - F.col("toxic") * 3
    df = F.pmod(d * 7 + n, F.lit(5)) + 1
    cl_json = F.when(F.pmod(d + n, F.lit(17)) == 0, F.lit("true")).otherwise(cl.cast("string"))
    judge = F.concat(F.lit('{"groundedness_score": '), g.cast("string"),
                     F.lit(', "answer_correctness_score": '), c.cast("string"),
                     F.lit(', "clarity_score": '), cl_json,
                     F.lit(', "difficulty_score": '), df.cast("string"),
                     F.lit(', "groundedness_explanation": "g'), g.cast("string"),
                     F.lit('", "answer_correctness_explanation": "c'), c.cast("string"),
                     F.lit('", "clarity_explanation": "l'), cl.cast("string"),
                     F.lit('", "difficulty_explanation": "d'), df.cast("string"), F.lit('"}'))
    return a.select(F.col("doc_id").alias("slot_id"), F.col("source").alias("session_id"), "attempt_number",
                    F.col("text").alias("question_text"), output.alias("output_text"), judge.alias("judge_text"),
                    (F.pmod(F.col("doc_id"), F.lit(5)) + 1).cast("int").alias("assigned_difficulty"))


def question_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions already asked in a session: the unlabelled documents of the same source."""
    docs = spread(table(spark, sf_dir, "documents")).join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")
    return docs.select(F.col("source").alias("session_id"), F.col("text").alias("question_text"))


def judged_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.operators import quality as q
    a = generation_attempts(spark, sf_dir)
    a = q.question_rules(q.parse_outputs(a))
    a = q.mark_duplicates(a, question_history(spark, sf_dir))
    return q.attempt_outcomes(q.quality_gate(a))


# --- test sessions over the knowledge base ------------------------------------------------
RESULTS_PER_SESSION = 20  # fixed value: questions of a test by default


def topic_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark passage is a test session whose topics are its sentences / clauses."""
    from quarry.functions.text import parse_topics
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("session_id"),
                    parse_topics(F.regexp_replace("text", "[.!?]", ",")).alias("topics"),
                    F.lit(RESULTS_PER_SESSION).alias("total_results"),
                    (F.pmod(F.col("item_id"), F.lit(9)) + 2).cast("int").alias("requested"))


def session_retrieval(spark: SparkSession, sf_dir: str, mode: str = "vector") -> DataFrame:
    from quarry.operators.embedding import embed_hashing
    from quarry.operators.retrieval import multi_topic_retrieve
    # Vectors are as wide as many lines: scored as they are made, never kept; the payload is read from the lines again.
    index = hybrid_index(spark, sf_dir)
    return multi_topic_retrieve(index, topic_sessions(spark, sf_dir),
                                total_col="total_results", mode=mode,
                                topic_vector_fn=lambda df, c: embed_hashing(df, c))


def search_query_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark passage in two more web-search forms: as one quoted phrase, and with
    its commas turned into ``or`` (clauses become alternative AND groups)."""
    b = table(spark, sf_dir, "benchmark")
    phrase = b.select((F.col("item_id") * 10 + 1).alias("query_id"),
                      F.concat(F.lit('"'), F.regexp_replace("text", '"', ""), F.lit('"')).alias("query"))
    either = b.select((F.col("item_id") * 10 + 2).alias("query_id"),
                      F.replace(F.col("text"), F.lit(","), F.lit(" or ")).alias("query"))
    return phrase.unionByName(either)


def word_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short queries from every benchmark passage: at each of its first words two words, a quoted pair, three words
    of which the last is negated, and two alternatives (query_id = item * 1000 + place * 4 + form)."""
    words = F.regexp_extract_all(F.col("text"), F.lit(r"(\p{L}+)"), 1)
    w = (table(spark, sf_dir, "benchmark").select("item_id", words.alias("w"))
         .select("item_id", "w", F.explode(F.sequence(F.lit(0), F.least(F.size("w") - 4, F.lit(11)))).alias("i")).where("size(w) >= 4"))
    at = lambda k: F.col("w")[F.col("i") + k]
    forms = [F.concat_ws(" ", at(0), at(1)), F.concat(F.lit('"'), at(0), F.lit(" "), at(1), F.lit('"')),
             F.concat(at(0), F.lit(" "), at(1), F.lit(" -"), at(3)), F.concat(at(0), F.lit(" "), at(2), F.lit(" or "), at(3))]
    return w.select("item_id", "i", F.posexplode(F.array(*forms)).alias("form", "query")).select(
        (F.col("item_id") * 1000 + F.col("i") * 4 + F.col("form")).alias("query_id"), "query")


def search_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as search requests; every eleventh is blank and some ask for no or fewer results."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("query_id"),
                    F.when(F.col("item_id") % 11 == 0, F.lit(" \t")).otherwise(F.col("text")).alias("query"),
                    (F.col("item_id") % 7 - 1).cast("int").alias("num_results"))


def unchecked_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question records as they arrive: some difficulties are out of range, some texts blank."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("candidate_id"), F.lit("short_answer").alias("question_type"),
                    F.when(F.col("doc_id") % 13 == 0, F.lit("  ")).otherwise(F.col("text")).alias("question"),
                    F.array().cast("array<string>").alias("options"), F.array("lang").alias("expected_answer"),
                    F.lit("").alias("explanation"), (F.col("doc_id") % 7).cast("int").alias("difficulty"),
                    F.array(doc_path()).alias("source_paths"))


# --- graded turns -----------------------------------------------------------------------
HISTORY_BUDGET = 2000


def graded_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn with the reply that follows it, as question, answer and the grader's raw output; one
    output in nine is no valid grade."""
    c = table(spark, sf_dir, "conversations")
    asked = c.where("role = 'user'").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("question_number"), F.col("text").alias("question"))
    said = c.where("role = 'assistant'").select(F.col("conv_id").alias("session_id"), (F.col("turn") - 1).alias("question_number"), F.col("text").alias("answer"))
    return asked.join(said, ["session_id", "question_number"]).withColumn("grade_text", _grade_text("session_id", "question_number"))


def _grade_text(session: str, question: str):
    k = F.pmod(F.col(session) + F.col(question), F.lit(9))
    return (F.when(k == 0, F.lit('{"is_correct": "yes"}')).when(k % 2 == 0, F.lit('{"is_correct": true}'))
            .otherwise(F.lit('{"is_correct": false}')))


def all_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of every conversation; those of a user ask, and the reply in the next turn is the answer (null: none,
    and no grade)."""
    from pyspark.sql import Window
    c = table(spark, sf_dir, "conversations")
    after = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(1, 1)
    reply = F.min(F.when(F.col("role") == "assistant", F.col("text"))).over(after)
    turns = c.select("conv_id", "turn", F.coalesce(F.col("role") == "user", F.lit(False)).alias("asked"), F.col("text").alias("question"), reply.alias("answer"))
    return turns.withColumn("grade_text", F.when(F.col("answer").isNotNull(), _grade_text("conv_id", "turn")))


# --- prices as a table ------------------------------------------------------------------
def price_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pricing entry a supplier: its balance sets the rates (a negative one is no rate), a third lacks a field."""
    s = table(spark, sf_dir, "supplier")
    cents = F.floor("s_acctbal").cast("long").cast("string")
    full = F.concat(F.lit('{"input": '), cents, F.lit(', "cached_input": 1, "output": 3}'))
    short = F.concat(F.lit('{"input": '), cents, F.lit(', "output": 3}'))
    return s.select(F.col("s_name").alias("model"), F.when(F.col("s_suppkey") % 3 == 0, short).otherwise(full).alias("rates_json"))
