"""DuckDB SQL of the Markdown chunker, written from the rules in quarry.operators.chunking.

RE2 has no (?U) flag and no look-behind, so Unicode whitespace is an explicit
class and the sentence split uses a marker character.
"""

from __future__ import annotations

WS = r"[\t\n\x{0B}\f\r\x{85}\p{Z}]"
SEP = r"[\n\r\x{0B}\x{0C}\x{1C}\x{1D}\x{1E}\x{85}\x{2028}\x{2029}]"
HEADING = f"^{WS}{{0,3}}#{{1,6}}{WS}+.+$"
LEVEL = f"^{WS}{{0,3}}(#{{1,6}}){WS}+"
FENCE = f"^{WS}{{0,3}}(```+|~~~+)"
LIST = f"^{WS}*(?:[-*+]{WS}+|\\p{{Nd}}+[.)]{WS}+)"
RULE = f"^{WS}{{0,3}}(?:(?:-{WS}*){{3,}}|(?:\\*{WS}*){{3,}}|(?:_{WS}*){{3,}})$"
BLANK = f"^{WS}*$"
STRIP = f"^{WS}+|{WS}+$"
LOW = "'where', 'and', 'or', 'because', 'therefore'"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '{STRIP}', '', 'g')"


def chunk_sql(files: str) -> str:
    """``files``: SQL yielding (source_path, content) -> (source_path, chunk_index, content)."""
    w = "PARTITION BY source_path ORDER BY ln"
    upto = f"({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    before = f"({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    after = f"({w} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
    hp = ",\n".join(
        f"last(CASE WHEN eff_heading AND level = {lv} THEN ln END IGNORE NULLS) OVER {upto} AS hp{lv}, "
        f"last(CASE WHEN eff_heading AND level = {lv} THEN {_strip('line')} END IGNORE NULLS) OVER {upto} AS ht{lv}"
        for lv in range(1, 7))
    alive = []
    for lv in range(1, 7):
        shallower = ", ".join([f"coalesce(hp{s}, -1)" for s in range(1, lv)] + ["-1"])
        alive.append(f"CASE WHEN hp{lv} IS NOT NULL AND hp{lv} > greatest({shallower}) THEN ht{lv} END")
    return f"""
WITH f AS (SELECT source_path, replace(content, chr(13) || chr(10), chr(10)) AS t FROM ({files})),
a AS (
    SELECT source_path, CASE WHEN length(t) = 0 THEN CAST([] AS VARCHAR[])
                             WHEN regexp_matches(t, '{SEP}$') THEN p[1:len(p) - 1] ELSE p END AS lines
    FROM (SELECT source_path, t, regexp_split_to_array(t, '{SEP}') AS p FROM f)),
l AS (SELECT source_path, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS ln FROM a),
c AS (
    SELECT *, regexp_matches(line, '{HEADING}') AS is_heading,
           length(regexp_extract(line, '{LEVEL}', 1)) AS level,
           regexp_matches(line, '{FENCE}') AS is_fence, regexp_matches(line, '{LIST}') AS is_list,
           regexp_matches(line, '{RULE}') AS is_rule, regexp_matches(line, '{BLANK}') AS is_blank
    FROM l),
c1 AS (SELECT *, coalesce(sum(CAST(is_fence AS INTEGER)) OVER {before}, 0) % 2 = 1 AS in_fence FROM c),
c2 AS (SELECT *, is_heading AND NOT in_fence AS eff_heading,
              is_rule AND NOT in_fence AND NOT (is_heading AND NOT in_fence) AS eff_rule FROM c1),
c3 AS (SELECT *, eff_heading OR eff_rule AS hard, eff_heading OR eff_rule OR (is_blank AND NOT in_fence) AS sep
       FROM c2),
c4 AS (SELECT *, {hp},
              last(CASE WHEN sep THEN ln END IGNORE NULLS) OVER {upto} AS sep_ln,
              last(CASE WHEN is_list AND NOT sep THEN ln END IGNORE NULLS) OVER {upto} AS list_ln
       FROM c3),
c5 AS (SELECT *, array_to_string(list_filter([{", ".join(alive)}], lambda x: x IS NOT NULL), chr(10)) AS context,
              CASE WHEN NOT sep THEN coalesce(list_ln, -1) > coalesce(sep_ln, -1) END AS run_has_list
       FROM c4),
c6 AS (SELECT *, last(CASE WHEN NOT sep THEN ln END IGNORE NULLS) OVER {before} AS prev_end,
              last(CASE WHEN NOT sep THEN run_has_list END IGNORE NULLS) OVER {before} AS prev_list,
              last(CASE WHEN hard THEN ln END IGNORE NULLS) OVER {before} AS last_hard,
              NOT sep AND coalesce(lag(sep) OVER ({w}), true) AS run_start
       FROM c5),
c7 AS (SELECT *, CASE WHEN NOT sep THEN run_start AND prev_end IS NOT NULL AND coalesce(last_hard, -1) < prev_end
                                       AND coalesce(prev_list, false) AND is_list END AS joins FROM c6),
c8 AS (SELECT *, sum(CAST(run_start AND NOT coalesce(joins, false) AS INTEGER)) OVER {upto} AS block_id,
              first(CASE WHEN NOT sep THEN joins END IGNORE NULLS) OVER {after} AS next_joins FROM c7),
kept AS (SELECT * FROM c8 WHERE NOT sep OR (is_blank AND NOT in_fence AND coalesce(next_joins, false))),
blocks AS (
    SELECT source_path, block_id, any_value(context) AS context, max(CAST(is_list AS INTEGER)) AS has_list,
           {_strip("string_agg(line, chr(10) ORDER BY ln)")} AS text
    FROM kept GROUP BY source_path, block_id),
emit AS (
    SELECT *, regexp_matches(text, '{FENCE}') OR has_list = 1 AS atomic FROM (
        SELECT *, {_strip(f"array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '{BLANK}') AND NOT regexp_matches(x, '{HEADING}') AND NOT regexp_matches(x, '{RULE}')), ' ')")} AS sub_text
        FROM blocks WHERE length(text) > 0)
    WHERE length(sub_text) > 0 AND lower(sub_text) NOT IN ({LOW})),
whole AS (SELECT source_path, block_id, context, 0 AS grp, 0 AS piece, text AS piece_text
          FROM emit WHERE atomic OR length(text) <= 500),
sents AS (
    SELECT source_path, block_id, context, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS si
    FROM (SELECT *, string_split(regexp_replace(text, '([.!?]){WS}+', '\\1' || chr(1), 'g'), chr(1)) AS s
          FROM emit WHERE NOT atomic AND length(text) > 500)),
grouped AS (
    SELECT *, 2 * sum(CAST(length(sentence) > 500 AS INTEGER)) OVER (PARTITION BY source_path ORDER BY block_id, si
                                                                      ROWS UNBOUNDED PRECEDING)
              - CAST(length(sentence) > 500 AS INTEGER) AS grp,
           CASE WHEN length(sentence) > 500
                THEN list_filter(regexp_split_to_array(sentence, '{WS}+'), lambda x: x <> '')
                ELSE [sentence] END AS us
    FROM sents),
units AS (SELECT source_path, block_id, context, grp, si, unnest(us) AS unit, generate_subscripts(us, 1) AS ui
          FROM grouped),
packed AS (
    SELECT source_path, block_id, context, grp,
           list_reduce(list(unit ORDER BY si, ui),
                       lambda acc, u: CASE WHEN acc.cur IS NULL THEN {{'p': acc.p, 'cur': u}}
                                           WHEN length(acc.cur) + 1 + length(u) <= 500
                                                THEN {{'p': acc.p, 'cur': acc.cur || ' ' || u}}
                                           ELSE {{'p': list_append(acc.p, acc.cur), 'cur': u}} END,
                       {{'p': CAST([] AS VARCHAR[]), 'cur': CAST(NULL AS VARCHAR)}}) AS r
    FROM units GROUP BY source_path, block_id, context, grp),
pieces AS (
    SELECT source_path, block_id, context, grp, unnest(ps) AS piece_text, generate_subscripts(ps, 1) - 1 AS piece
    FROM (SELECT *, CASE WHEN r.cur IS NULL THEN r.p ELSE list_append(r.p, r.cur) END AS ps FROM packed)),
allp AS (SELECT * FROM whole UNION ALL SELECT source_path, block_id, context, grp, piece, piece_text FROM pieces)
SELECT source_path,
       CAST(row_number() OVER (PARTITION BY source_path ORDER BY block_id, grp, piece) - 1 AS INTEGER) AS chunk_index,
       CASE WHEN context <> '' THEN context || chr(10) || chr(10) || piece_text ELSE piece_text END AS content
FROM allp
"""
