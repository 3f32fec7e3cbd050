"""Lexical search as joins over a postings table (OP-R4..R7, OP-W2, OP-T2).

* ``postings``: (chunk key, position, lexeme); positions count stop words, as a
  full-text vector does; lexemes are S-stemmed.
* ``query_terms``: web-search syntax -> one row per query lexeme with its OR
  group, item (word or quoted phrase), offset inside the phrase and negation.
* ``lexical_match``: chunks that satisfy a query = postings joined to the query
  terms on lexeme (query side broadcast when its size is proven small; else a
  shuffle join that AQE splits on hot lexemes), phrases checked by anchor
  position, groups by counting matched items, NOT by an anti condition.
* ``cover_density``: ts_rank_cd-style score from minimal covers, with window
  functions only (no per-chunk Python).

``build_postings`` keeps the postings of a chunk together, as the tokens in its row: then match and score
come from one scan of the chunks (``chunk_scan``) with the query terms broadcast, whose number must be known.
Chunks whose keys are not whole or not unique, and terms beyond the broadcast bound, take the joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import is_stop_word, s_stem, tokens
from quarry.operators.chunk_scan import DEFAULT_WEIGHT, parsed, scan
from quarry.session import bounded

# Query items: an optionally negated quoted phrase (an open quote runs to the end),
# or a run of characters that are neither space nor quote.
ITEM_PATTERN = r'(-?"[^"]*"?|[^\s"]+)'
MAX_BROADCAST_TERMS = 2_000_000


def postings(chunks: DataFrame, key_cols: Sequence[str] = ("source_path", "chunk_index"),
             text_col: str = "content") -> DataFrame:
    """Inverted-index rows: key columns, pos (1-based, stop words counted), lexeme."""
    keys = list(key_cols)
    exploded = chunks.select(*keys, F.posexplode(tokens(text_col)).alias("pos", "token"))
    return (exploded.where(~is_stop_word("token"))
            .select(*keys, (F.col("pos") + 1).cast("int").alias("pos"), s_stem("token").alias("lexeme")))


def build_postings(chunks: DataFrame, key_cols: Sequence[str] = ("source_path", "chunk_index"),
                   text_col: str = "content") -> DataFrame:
    """Postings by chunk: key columns and ``tokens`` (stop words in place, not stemmed).  One row a chunk, which the
    jobs below read once or twice; ``exploded`` gives the flat form."""
    return chunks.select(*key_cols, tokens(text_col).alias("tokens"))


def exploded(post: DataFrame) -> DataFrame:
    """Postings by chunk as inverted-index rows."""
    keys = [c for c in post.columns if c != "tokens"]
    rows = post.select(*keys, F.posexplode("tokens").alias("pos", "token")).where(~is_stop_word("token"))
    return rows.select(*keys, (F.col("pos") + 1).cast("int").alias("pos"), s_stem("token").alias("lexeme"))


def _by_chunk(post: DataFrame, term_rows: int | None) -> bool:
    return "tokens" in post.columns and term_rows is not None and term_rows <= MAX_BROADCAST_TERMS


def _parted(post: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Postings by chunk of the chunks whose keys are whole and unique, and those of the others (None: there are none)."""
    from quarry.session import cut_lineage
    none = F.greatest(*[F.col(c).isNull() for c in keys]) if len(keys) > 1 else F.col(keys[0]).isNull()
    counts = post.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    odd = cut_lineage(counts.where((F.col("_n") > 1) | none).select(*keys))
    if odd.isEmpty():
        return post, None
    whole = post.where(~none)
    odd = bounded(odd.where(~none))
    return whole.join(odd, keys, "left_anti"), whole.join(odd, keys, "left_semi").unionByName(post.where(none))


ITEM_STRIDE = 1 << 32


def prepared_terms(queries: DataFrame, query_id: str = "query_id", text_col: str = "query"):
    """Query terms materialised once (they feed several joins) and their row count,
    which proves the broadcast bound of the query side."""
    from quarry.session import cut_lineage
    terms = cut_lineage(query_terms(queries, query_id, text_col))
    return terms, terms.count()


def query_terms(queries: DataFrame, query_id: str = "query_id", text_col: str = "query") -> DataFrame:
    """Parse web-search syntax into term rows.

    Output: query_id, group_id, item_id, negated, offset, lexeme, plus
    n_item_terms (distinct offsets of the item's lexemes).  Bare words are their
    own items; a quoted phrase is one item whose lexemes must appear at their
    offsets.  Items with only stop words vanish; "or" separates groups.
    """
    items = queries.select(query_id, F.posexplode(F.regexp_extract_all(F.col(text_col), F.lit(ITEM_PATTERN), 1))
                           .alias("item_pos", "raw"))
    w = Window.partitionBy(query_id).orderBy("item_pos").rowsBetween(Window.unboundedPreceding, 0)
    is_or = F.lower(F.col("raw")) == "or"
    items = (items.withColumn("group_id", F.sum(is_or.cast("int")).over(w))
             .where(~is_or)
             .withColumn("negated", F.col("raw").startswith("-") & (F.length("raw") > 1))
             .withColumn("is_phrase", F.col("raw").contains('"')))
    toks = items.select(query_id, "group_id", "item_pos", "negated", "is_phrase",
                        F.posexplode(tokens(F.col("raw"))).alias("term_offset", "token"))
    toks = toks.where(~is_stop_word("token"))
    # A bare item with several tokens ("well-known") contributes each token as its own item.
    # Both numbers are 32-bit, so the id is unique however long an item is.
    first_id = F.col("item_pos").cast("long") * F.lit(ITEM_STRIDE)
    item_id = F.when(F.col("is_phrase"), first_id).otherwise(first_id + F.col("term_offset"))
    offset = F.when(F.col("is_phrase"), F.col("term_offset")).otherwise(F.lit(0))
    terms = toks.select(query_id, "group_id", item_id.cast("long").alias("item_id"), "negated",
                        offset.cast("int").alias("term_offset"), s_stem("token").alias("lexeme"))
    terms = terms.dropDuplicates([query_id, "group_id", "item_id", "term_offset", "lexeme"])
    wi = Window.partitionBy(query_id, "group_id", "item_id")
    return terms.withColumn("n_item_terms", F.size(F.collect_set("term_offset").over(wi)).cast("int"))


def _sized(df: DataFrame, bound_rows: int | None) -> DataFrame:
    return F.broadcast(df) if bound_rows is not None and bound_rows <= MAX_BROADCAST_TERMS else df


def lexeme_frequency(post: DataFrame) -> DataFrame:
    """Postings per lexeme (map-side combined); a stored index keeps this table beside the postings."""
    return post.groupBy("lexeme").agg(F.count(F.lit(1)).alias("df"))


def candidate_hits(post: DataFrame, terms: DataFrame, key_cols: Sequence[str] = ("source_path", "chunk_index"),
                   query_id: str = "query_id", term_rows: int | None = None,
                   frequency: DataFrame | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """Postings of query lexemes, restricted to chunks that can satisfy some OR group.

    A chunk can satisfy a group only if it holds the group's rarest positive
    lexeme, so candidates come from that lexeme's postings alone; every other
    lexeme is then looked up only inside the candidate chunks.  The result is
    exact: (query, chunk, group) triples outside the candidates cannot match.  ``allowed``
    (query and some of the key columns) keeps candidates of those pairs only.
    """
    keys = list(key_cols)
    freq = frequency if frequency is not None else lexeme_frequency(post)
    pos = terms.where(~F.col("negated")).select(query_id, "group_id", "lexeme").distinct()
    # Frequencies stream against the broadcast query lexemes (never the other way round).
    rated = freq.join(_sized(pos, term_rows), "lexeme")
    n_pos = pos.groupBy(query_id, "group_id").agg(F.count(F.lit(1)).alias("n_pos"))
    # A group with a lexeme absent from the index can never match: it yields no candidates.
    rarest = (rated.groupBy(query_id, "group_id")
              .agg(F.min_by("lexeme", F.struct("df", "lexeme")).alias("lexeme"),
                   F.count(F.lit(1)).alias("n_found"))
              .join(_sized(n_pos, term_rows), [query_id, "group_id"])
              .where(F.col("n_found") == F.col("n_pos")).select(query_id, "group_id", "lexeme"))
    cands = post.join(_sized(rarest, term_rows), "lexeme").select(query_id, "group_id", *keys).distinct()
    if allowed is not None:
        cands = cands.join(bounded(allowed), allowed.columns, "left_semi")
    # Every (candidate chunk, lexeme of the group, incl. negated) the chunk has to be probed for.
    # Counted, then broadcast against the postings stream; the postings are never broadcast.
    needed = bounded(cands.join(_sized(terms, term_rows), [query_id, "group_id"]))
    return post.join(needed, [*keys, "lexeme"])


def _item_hits(hits: DataFrame, keys: list[str], query_id: str) -> DataFrame:
    """Items present in a chunk: at some anchor (pos - offset) all their offsets are there."""
    return (hits.groupBy(query_id, *keys, "group_id", "item_id", "negated", "n_item_terms",
                         (F.col("pos") - F.col("term_offset")).alias("anchor"))
            .agg(F.count_distinct("term_offset").alias("c"))
            .where(F.col("c") == F.col("n_item_terms"))
            .select(query_id, *keys, "group_id", "item_id", "negated").distinct())


def negated_groups(terms: DataFrame, query_id: str = "query_id") -> DataFrame:
    """OR groups that hold negated items only."""
    return (terms.groupBy(query_id, "group_id").agg(F.bool_and("negated").alias("only"))
            .where("only").select(query_id, "group_id"))


def match_negated(post: DataFrame, terms: DataFrame, chunks: DataFrame, keys: list[str], query_id: str,
                   term_rows: int | None) -> DataFrame:
    """Chunks without any item of a negated group.  The answer is nearly every chunk for each such
    query, so the (stated) groups meet the chunks in one pass over them."""
    groups = _sized(negated_groups(terms, query_id), term_rows)
    items = terms.join(groups, [query_id, "group_id"], "left_semi")
    held = _item_hits(post.join(_sized(items, term_rows), "lexeme"), keys, query_id)
    return (chunks.select(*keys).join(groups, F.lit(True))
            .join(held, [query_id, "group_id", *keys], "left_anti").select(query_id, *keys).distinct())


def _match_from_hits(hits: DataFrame, terms: DataFrame, keys: list[str], query_id: str,
                     term_rows: int | None) -> DataFrame:
    item_hit = _item_hits(hits, keys, query_id)
    sizes = (terms.where(~F.col("negated")).groupBy(query_id, "group_id")
             .agg(F.count_distinct("item_id").alias("n_items")))
    groups = (item_hit.groupBy(query_id, *keys, "group_id")
              .agg(F.count_distinct(F.when(~F.col("negated"), F.col("item_id"))).alias("pos_hit"),
                   F.count_if(F.col("negated")).alias("neg_hit"))
              .join(_sized(sizes, term_rows), [query_id, "group_id"])
              .where((F.col("pos_hit") == F.col("n_items")) & (F.col("neg_hit") == 0)))
    return groups.select(query_id, *keys).distinct()


def lexical_match(post: DataFrame, terms: DataFrame, key_cols: Sequence[str] = ("source_path", "chunk_index"),
                  query_id: str = "query_id", term_rows: int | None = None,
                  hits: DataFrame | None = None, chunks: DataFrame | None = None, scored: bool = False) -> DataFrame:
    """(query_id, *keys) for every chunk that satisfies the query (``@@``).  ``chunks`` holds the keys of
    every chunk, also of those without a lexeme: an OR group of negated items only matches among them.
    With ``scored`` the cover density that ``cover_density`` gives comes along (null: no cover)."""
    keys = list(key_cols)
    if _by_chunk(post, term_rows) and hits is None:
        own, odd = _parted(post, keys)
        queries, of = parsed(terms, query_id)
        found = scan(own, queries, keys, by_absence=chunks is not None).join(F.broadcast(of), "_shape")
        score = F.when(F.col("lexical_score") > 0, F.col("lexical_score")).alias("lexical_score")
        found = found.select(query_id, *keys, *([score] if scored else []))
        if odd is None:
            return found
        others = lexical_match(exploded(odd), terms, keys, query_id, term_rows, None, None if chunks is None else odd.select(*keys), scored)
        return found.unionByName(others)
    if "tokens" in post.columns:
        post = exploded(post)
    if scored:
        found = lexical_match(post, terms, keys, query_id, term_rows, hits, chunks)
        return found.join(cover_density(post, terms, found, keys, query_id, term_rows), [query_id, *keys], "left")
    h = hits if hits is not None else candidate_hits(post, terms, keys, query_id, term_rows)
    out = _match_from_hits(h, terms, keys, query_id, term_rows)
    if chunks is None or not negated_groups(terms, query_id).head(1):
        return out
    return out.unionByName(match_negated(post, terms, chunks, keys, query_id, term_rows)).distinct()


def cover_density(post: DataFrame, terms: DataFrame, matched: DataFrame,
                  key_cols: Sequence[str] = ("source_path", "chunk_index"),
                  query_id: str = "query_id", term_rows: int | None = None,
                  hits: DataFrame | None = None) -> DataFrame:
    """Cover-density score for matched (query, chunk) pairs.

    Positive lexemes only (negations and phrase order do not change covers).
    For every hit position r: left(r) = max over OR groups of the min over the
    group's lexemes of their latest position <= r.  Covers are (left, r) for the
    first r of each distinct left; score = sum 0.1 / (1 + noise), noise =
    (r - left) - (hit positions inside the cover - 1); returned as float4.
    Scores that ``lexical_match`` found with its matches are taken from there.
    """
    keys = list(key_cols)
    if "lexical_score" in matched.columns:
        return matched.where(F.col("lexical_score").isNotNull()).select(query_id, *keys, "lexical_score")
    if "tokens" in post.columns:
        post = exploded(post)
    part = [query_id, *keys]
    pos_terms = terms.where(~F.col("negated")).select(query_id, "group_id", "lexeme").distinct()
    qlex = pos_terms.select(query_id, "lexeme").distinct()
    # Positions of every positive query lexeme inside the matched chunks (all OR groups count).
    hits_m = (post.join(bounded(matched.select(*part)), keys).join(_sized(qlex, term_rows), [query_id, "lexeme"])
              .select(*part, "pos", "lexeme").distinct())
    positions = (hits_m.groupBy(*part, "pos").agg(F.collect_set("lexeme").alias("lexs"))
                 .withColumn("entry", F.row_number().over(Window.partitionBy(*part).orderBy("pos"))))
    # Used twice below (grid and cover starts): materialise once instead of re-running the match.
    from quarry.session import cut_lineage
    positions = cut_lineage(positions)
    # Every (hit position, group lexeme) pair: is the lexeme at this position?
    grid = positions.join(_sized(pos_terms, term_rows), query_id)
    grid = grid.select(*part, "pos", "entry", "group_id", "lexeme",
                       F.when(F.array_contains("lexs", F.col("lexeme")), F.col("pos")).alias("here"))
    wl = (Window.partitionBy(*part, "group_id", "lexeme").orderBy("pos")
          .rowsBetween(Window.unboundedPreceding, 0))
    grid = grid.withColumn("latest", F.max("here").over(wl))
    n_lex = pos_terms.groupBy(query_id, "group_id").agg(F.count(F.lit(1)).alias("n_lex"))
    per_group = (grid.groupBy(*part, "pos", "entry", "group_id")
                 .agg(F.min("latest").alias("left_g"), F.count("latest").alias("seen"))
                 .join(_sized(n_lex, term_rows), [query_id, "group_id"])
                 .where(F.col("seen") == F.col("n_lex")))
    ends = per_group.groupBy(*part, "pos", "entry").agg(F.max("left_g").alias("left"))
    covers = (ends.groupBy(*part, "left").agg(F.min(F.struct("pos", "entry")).alias("r"))
              .select(*part, "left", F.col("r.pos").alias("right"), F.col("r.entry").alias("right_entry")))
    left_entry = positions.select(*part, F.col("pos").alias("left"), F.col("entry").alias("left_entry"))
    covers = covers.join(left_entry, [*part, "left"])
    noise = (F.col("right") - F.col("left")) - (F.col("right_entry") - F.col("left_entry"))
    return (covers.groupBy(*part)
            .agg(F.sum(F.lit(DEFAULT_WEIGHT) / (F.lit(1.0) + noise)).alias("score"))
            .select(*part, F.col("score").cast("float").cast("double").alias("lexical_score")))


def lexical_topk(post: DataFrame, terms: DataFrame, k: int,
                 key_cols: Sequence[str] = ("source_path", "chunk_index"),
                 query_id: str = "query_id", term_rows: int | None = None,
                 chunks: DataFrame | None = None) -> DataFrame:
    """Matching chunks ranked by cover density, first ``k`` per query (ties: key order); a chunk
    matched only by the absence of words (``chunks``, see ``lexical_match``) scores 0."""
    keys = list(key_cols)
    by_chunk = _by_chunk(post, term_rows)
    own, odd = _parted(post, keys) if by_chunk else (None, exploded(post) if "tokens" in post.columns else post)
    found = None
    if by_chunk:
        queries, of = parsed(terms, query_id)
        found = first_of_shapes(scan(own, queries, keys, k, chunks is not None), of, k, keys, query_id)
        if odd is None:
            return found
        chunks = None if chunks is None else odd.select(*keys)
        odd = exploded(odd)
    from quarry.session import cut_lineage
    hits = candidate_hits(odd, terms, keys, query_id, term_rows)
    matched = cut_lineage(lexical_match(odd, terms, keys, query_id, term_rows, hits, chunks))
    scored = cover_density(odd, terms, matched, keys, query_id, term_rows)
    if chunks is not None and negated_groups(terms, query_id).head(1):
        scored = matched.join(scored, [query_id, *keys], "left").fillna(0.0, ["lexical_score"])
    if found is not None:
        scored = found.drop("lexical_rank").unionByName(scored.select(query_id, *keys, "lexical_score"))
    return _ranked(scored, k, keys, query_id)


def _ranked(scored: DataFrame, k: int, keys: list[str], query_id: str) -> DataFrame:
    w = Window.partitionBy(query_id).orderBy(F.col("lexical_score").desc(), *[F.col(c).asc() for c in keys])
    return (scored.withColumn("lexical_rank", F.row_number().over(w))
            .where(F.col("lexical_rank") <= k)
            .withColumn("lexical_rank", F.col("lexical_rank").cast("long")))


def first_of_shapes(found: DataFrame, of: DataFrame, k: int, keys: list[str], query_id: str) -> DataFrame:
    """The first ``k`` chunks of each query from those that the tasks of a scan found for each query shape."""
    top = _ranked(found.where(F.col("possible").isNull()).select("_shape", *keys, "lexical_score"), k, keys, "_shape")
    return top.join(F.broadcast(of), "_shape").select(query_id, *keys, "lexical_score", "lexical_rank")
