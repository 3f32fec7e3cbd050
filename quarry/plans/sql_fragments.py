"""DuckDB SQL for the fixture views, mirrored from ``quarry.plans.fixtures``."""

DOC_PATH_SQL = "'kb/' || source || '/' || lang || '/doc-' || CAST(doc_id AS VARCHAR) || '.md'"

VECTOR_INDEX_SQL = f"""
    SELECT {DOC_PATH_SQL} AS source_path, 0 AS chunk_index, d.text AS content, e.embedding
    FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id
"""

# Usage log built from events: error events carry no usage; view events omit
# total_tokens; signup events send total_tokens = null.
USAGE_LOG_SQL = """
    SELECT response_id, created_at, operation, model,
           CASE operation
             WHEN 'error' THEN NULL
             WHEN 'view' THEN '{"input_tokens": ' || it || ', "output_tokens": ' || ot
                  || ', "input_tokens_details": {"cached_tokens": ' || k || '}}'
             WHEN 'signup' THEN '{"input_tokens": ' || it || ', "output_tokens": ' || ot
                  || ', "total_tokens": null, "input_tokens_details": {"cached_tokens": ' || k || '}}'
             ELSE '{"input_tokens": ' || it || ', "output_tokens": ' || ot || ', "total_tokens": ' || tt
                  || ', "input_tokens_details": {"cached_tokens": ' || k || '}}'
           END AS usage_json
    FROM (
        SELECT 'resp-' || CAST(event_id AS VARCHAR) AS response_id, ts AS created_at,
               event_type AS operation, 'm' || CAST(user_id % 4 AS VARCHAR) AS model,
               CAST(CAST(floor(value * 10) AS BIGINT) AS VARCHAR) AS it,
               CAST(CAST(floor(value * 3) AS BIGINT) AS VARCHAR) AS ot,
               CAST(CAST(floor(value * 10) AS BIGINT) + CAST(floor(value * 3) AS BIGINT) AS VARCHAR) AS tt,
               CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) AS VARCHAR) AS k
        FROM events
    )
"""

PRICING_SQL = """
    SELECT * FROM (VALUES
        ('m0', CAST(2 AS DOUBLE), CAST(0.2 AS DOUBLE), CAST(8 AS DOUBLE)),
        ('m1', CAST(1.25 AS DOUBLE), CAST(0.125 AS DOUBLE), CAST(10 AS DOUBLE)),
        ('m2', CAST(0.15 AS DOUBLE), CAST(0.075 AS DOUBLE), CAST(0.6 AS DOUBLE))
    ) AS p(model, input_rate, cached_rate, output_rate)
"""

USAGE_SQL = f"""
    SELECT response_id, created_at, operation, model, input_tokens, cached_input_tokens, output_tokens,
           total_tokens,
           CAST(ic AS DECIMAL(18,10)) AS input_cost_usd,
           CAST(cc AS DECIMAL(18,10)) AS cached_input_cost_usd,
           CAST(oc AS DECIMAL(18,10)) AS output_cost_usd,
           CAST(ic + cc + oc AS DECIMAL(18,10)) AS total_cost_usd
    FROM (
        SELECT l.response_id, l.created_at, l.operation, l.model,
               coalesce(it, 0) AS input_tokens, coalesce(ct, 0) AS cached_input_tokens,
               coalesce(ot, 0) AS output_tokens,
               CASE WHEN list_contains(json_keys(usage_json), 'total_tokens') THEN coalesce(tt, 0)
                    ELSE coalesce(it, 0) + coalesce(ot, 0) END AS total_tokens,
               CAST(greatest(0, coalesce(it, 0) - coalesce(ct, 0)) AS DOUBLE)
                   * coalesce(p.input_rate, CAST(5 AS DOUBLE)) / CAST(1000000 AS DOUBLE) AS ic,
               CAST(coalesce(ct, 0) AS DOUBLE)
                   * coalesce(p.cached_rate, CAST(0.5 AS DOUBLE)) / CAST(1000000 AS DOUBLE) AS cc,
               CAST(coalesce(ot, 0) AS DOUBLE)
                   * coalesce(p.output_rate, CAST(30 AS DOUBLE)) / CAST(1000000 AS DOUBLE) AS oc
        FROM (
            SELECT *, CAST(json_extract_string(usage_json, '$.input_tokens') AS BIGINT) AS it,
                      CAST(json_extract_string(usage_json, '$.output_tokens') AS BIGINT) AS ot,
                      CAST(json_extract_string(usage_json, '$.total_tokens') AS BIGINT) AS tt,
                      CAST(json_extract_string(usage_json, '$.input_tokens_details.cached_tokens') AS BIGINT) AS ct
            FROM ({USAGE_LOG_SQL}) WHERE usage_json IS NOT NULL
        ) l LEFT JOIN ({PRICING_SQL}) p ON l.model = p.model
    )
"""

SESSION_STARTS_SQL = """
    SELECT o_orderkey AS id, 'anon-' || CAST(o_custkey AS VARCHAR) AS anonymous_session_id,
           o_orderdate AS started_at, [o_orderstatus, o_orderpriority] AS topics,
           7 AS requested_questions
    FROM orders
"""

ANSWER_EVENTS_SQL = """
    SELECT l_orderkey AS session_id, l_linenumber AS question_number,
           ['short_answer', 'single_choice', 'multiple_choice'][(l_partkey % 3) + 1] AS question_type,
           CAST(l_quantity AS INTEGER) % 5 + 1 AS assigned_difficulty,
           greatest(1, least(5, CAST(l_quantity AS INTEGER) % 5 + 1
                               + CASE WHEN l_returnflag = 'R' THEN 1 ELSE -1 END)) AS next_difficulty,
           l_returnflag = 'R' AS is_correct, l_shipdate AS answered_at,
           l_partkey, l_suppkey, l_extendedprice
    FROM lineitem
"""

ANSWERS_SQL = f"""
    SELECT * EXCLUDE (rn) FROM (
        SELECT *, row_number() OVER (PARTITION BY session_id, question_number
                                     ORDER BY answered_at, l_partkey, l_suppkey, l_extendedprice) AS rn
        FROM ({ANSWER_EVENTS_SQL})
    ) WHERE rn = 1
"""

FINISH_SQL = """
    SELECT session_id, arg_min(struct_pack(finished_at, completed, ended_early),
                               struct_pack(finished_at, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS f
    FROM (
        SELECT l_orderkey AS session_id, l_shipdate AS finished_at, l_returnflag <> 'N' AS completed,
               l_linenumber < 4 AS ended_early, l_linenumber, l_partkey, l_suppkey, l_extendedprice
        FROM lineitem WHERE l_linestatus = 'F'
    ) GROUP BY session_id
"""

SESSIONS_SQL = f"""
    SELECT s.id, s.anonymous_session_id, s.started_at, f.f.finished_at AS completed_at, s.topics,
           s.requested_questions,
           coalesce(c.answered_questions, 0) AS answered_questions,
           coalesce(c.correct_answers, 0) AS correct_answers,
           coalesce(f.f.completed, false) AS completed, coalesce(f.f.ended_early, false) AS ended_early
    FROM ({SESSION_STARTS_SQL}) s
    LEFT JOIN (SELECT session_id, count(*) AS answered_questions,
                      count(*) FILTER (WHERE is_correct) AS correct_answers
               FROM ({ANSWERS_SQL}) GROUP BY session_id) c ON c.session_id = s.id
    LEFT JOIN ({FINISH_SQL}) f ON f.session_id = s.id
"""


# --- text ------------------------------------------------------------------------------
def _stop_list() -> str:
    from quarry.functions.text import STOP_WORDS
    return ", ".join(f"'{w}'" for w in STOP_WORDS)


def tokens_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def stem_sql(t: str) -> str:
    return f"""CASE WHEN length({t}) <= 3 THEN {t}
        WHEN suffix({t}, 'ies') AND NOT suffix({t}, 'eies') AND NOT suffix({t}, 'aies')
             THEN left({t}, length({t}) - 3) || 'y'
        WHEN suffix({t}, 'es') AND NOT (suffix({t}, 'aes') OR suffix({t}, 'ees') OR suffix({t}, 'oes'))
             THEN left({t}, length({t}) - 1)
        WHEN suffix({t}, 's') AND NOT (suffix({t}, 'us') OR suffix({t}, 'ss'))
             THEN left({t}, length({t}) - 1)
        ELSE {t} END"""


LINE_INDEX_SQL = f"""
    SELECT {DOC_PATH_SQL} AS source_path, CAST(i - 1 AS INTEGER) AS chunk_index, line AS content
    FROM (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line,
                 generate_subscripts(string_split(text, chr(10)), 1) AS i
          FROM documents)
"""

SEARCH_QUERIES_SQL = "SELECT item_id AS query_id, text AS query FROM benchmark"


def postings_sql(idx: str) -> str:
    return f"""
    SELECT source_path, chunk_index, CAST(i AS INTEGER) AS pos, {stem_sql('tok')} AS lexeme
    FROM (SELECT source_path, chunk_index, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i
          FROM (SELECT source_path, chunk_index, {tokens_sql('content')} AS toks FROM ({idx})))
    WHERE tok NOT IN ({_stop_list()})
"""


def query_terms_sql(q: str) -> str:
    items = "regexp_extract_all(query, '(-?\"[^\"]*\"?|[^\\s\"]+)', 1)"
    return f"""
    SELECT *, count(DISTINCT term_offset) OVER (PARTITION BY query_id, group_id, item_id) AS n_item_terms
    FROM (
      SELECT DISTINCT query_id, group_id,
             CAST(CAST(item_pos AS BIGINT) * 4294967296 + CASE WHEN is_phrase THEN 0 ELSE o END AS BIGINT) AS item_id,
             negated, CAST(CASE WHEN is_phrase THEN o ELSE 0 END AS INTEGER) AS term_offset,
             {stem_sql('token')} AS lexeme
      FROM (
        SELECT query_id, group_id, item_pos, starts_with(raw, '-') AND length(raw) > 1 AS negated,
               contains(raw, '"') AS is_phrase, unnest({tokens_sql('raw')}) AS token,
               generate_subscripts({tokens_sql('raw')}, 1) - 1 AS o
        FROM (
          SELECT *, sum(CASE WHEN lower(raw) = 'or' THEN 1 ELSE 0 END)
                      OVER (PARTITION BY query_id ORDER BY item_pos ROWS UNBOUNDED PRECEDING) AS group_id
          FROM (SELECT query_id, unnest({items}) AS raw, generate_subscripts({items}, 1) - 1 AS item_pos
                FROM ({q}))
        ) WHERE lower(raw) <> 'or'
      ) WHERE token NOT IN ({_stop_list()})
    )
"""


def lexical_sql(post: str, terms: str) -> str:
    """CTE body (without WITH) defining post_, terms_, matched_, scored_."""
    return f"""
post_ AS ({post}),
terms_ AS ({terms}),
hits_ AS (SELECT p.source_path, p.chunk_index, p.pos, t.* FROM post_ p JOIN terms_ t USING (lexeme)),
item_hit_ AS (
    SELECT DISTINCT query_id, source_path, chunk_index, group_id, item_id, negated FROM (
        SELECT query_id, source_path, chunk_index, group_id, item_id, negated
        FROM hits_ GROUP BY query_id, source_path, chunk_index, group_id, item_id, negated, n_item_terms,
                            pos - term_offset
        HAVING count(DISTINCT term_offset) = n_item_terms)),
sizes_ AS (SELECT query_id, group_id, count(DISTINCT item_id) AS n_items FROM terms_ WHERE NOT negated
           GROUP BY ALL),
matched_ AS (
    SELECT DISTINCT g.query_id, g.source_path, g.chunk_index FROM (
        SELECT query_id, source_path, chunk_index, group_id,
               count(DISTINCT item_id) FILTER (WHERE NOT negated) AS pos_hit,
               count(*) FILTER (WHERE negated) AS neg_hit
        FROM item_hit_ GROUP BY ALL) g JOIN sizes_ s USING (query_id, group_id)
    WHERE pos_hit = n_items AND neg_hit = 0),
pos_terms_ AS (SELECT DISTINCT query_id, group_id, lexeme FROM terms_ WHERE NOT negated),
chits_ AS (
    SELECT DISTINCT q.query_id, p.source_path, p.chunk_index, p.pos, p.lexeme
    FROM post_ p JOIN (SELECT DISTINCT query_id, lexeme FROM pos_terms_) q USING (lexeme)
    SEMI JOIN matched_ m ON m.query_id = q.query_id AND m.source_path = p.source_path
                         AND m.chunk_index = p.chunk_index),
positions_ AS (
    SELECT query_id, source_path, chunk_index, pos, list(lexeme) AS lexs,
           row_number() OVER (PARTITION BY query_id, source_path, chunk_index ORDER BY pos) AS entry
    FROM chits_ GROUP BY query_id, source_path, chunk_index, pos),
grid_ AS (
    SELECT p.query_id, p.source_path, p.chunk_index, p.pos, p.entry, t.group_id, t.lexeme,
           max(CASE WHEN list_contains(p.lexs, t.lexeme) THEN p.pos END)
             OVER (PARTITION BY p.query_id, p.source_path, p.chunk_index, t.group_id, t.lexeme
                   ORDER BY p.pos ROWS UNBOUNDED PRECEDING) AS latest
    FROM positions_ p JOIN pos_terms_ t USING (query_id)),
nlex_ AS (SELECT query_id, group_id, count(*) AS n_lex FROM pos_terms_ GROUP BY ALL),
ends_ AS (
    SELECT query_id, source_path, chunk_index, pos, entry, max(left_g) AS lft FROM (
        SELECT g.query_id, source_path, chunk_index, pos, entry, g.group_id,
               min(latest) AS left_g, count(latest) AS seen, any_value(n_lex) AS n_lex
        FROM grid_ g JOIN nlex_ n ON n.query_id = g.query_id AND n.group_id = g.group_id
        GROUP BY g.query_id, source_path, chunk_index, pos, entry, g.group_id)
    WHERE seen = n_lex GROUP BY ALL),
covers_ AS (SELECT query_id, source_path, chunk_index, lft, min(pos) AS rgt, min(entry) AS rgt_entry
            FROM ends_ GROUP BY ALL),
scored_ AS (
    SELECT c.query_id, c.source_path, c.chunk_index,
           CAST(CAST(sum(CAST(0.1 AS DOUBLE) / (1.0 + ((rgt - lft) - (rgt_entry - p.entry)))) AS FLOAT) AS DOUBLE)
             AS lexical_score
    FROM covers_ c JOIN positions_ p ON p.query_id = c.query_id AND p.source_path = c.source_path
                                    AND p.chunk_index = c.chunk_index AND p.pos = c.lft
    GROUP BY ALL)
"""


def buckets_sql(x: str, dim: int = 384) -> str:
    return (f"list_transform({tokens_sql(x)}, "
            f"lambda t: CAST((('0x' || substr(md5(t), 1, 8))::BIGINT % {dim}) AS INTEGER))")


def bucket_counts_sql(rel: str, id_cols: str, text: str, dim: int = 384) -> str:
    """Sparse hashed term counts: id columns, b, c."""
    return f"""
    SELECT {id_cols}, b, CAST(count(*) AS DOUBLE) AS c
    FROM (SELECT {id_cols}, unnest({buckets_sql(text, dim)}) AS b FROM ({rel}))
    GROUP BY ALL
"""
