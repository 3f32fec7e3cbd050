"""Structure-aware Markdown chunking as one Spark job (OP-C1..C11).

The lines of a document are one row.  They are classified with regexes, and all sequential state of a
line-by-line chunker is one ``aggregate`` fold over what the lines are:

* fence parity: whether an odd number of fence lines came before the line;
* heading context: per level, the latest heading of that level that no
  shallower heading followed;
* blocks: maximal runs of non-separator lines (separators: out-of-fence
  blank, heading, rule); run j joins run j-1 when only blank lines lie between,
  run j-1 has a list line and run j starts with one (blank lines kept).  A block is
  a range of lines, so the fold keeps its first and last line only;
* long prose blocks: sentence split, greedy packing to 500 characters with
  one ``aggregate`` fold per block (oversize sentences word-packed by a nested fold).

Documents are dealt out once, by path; no line is a row of its own, sorted or shuffled.  The fold
appends blocks to short lists of FOLD_LINES lines each, so its time is in proportion to the lines.

Documents over LARGE_CHARS are cut into segments of SEGMENT_LINES lines that tasks share.  A segment is
summarised by what it passes on (fence count, last heading of each level, last separator, list, hard
break and run, whether its last run has a list, block starts, its first join); the summaries
are composed in order, a few rows a document, and each segment runs the same rules, as window functions, with what
came before (and, for kept blank lines, after) it carried in.  Files that share a path are one document, which is also
cut so, however many they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import LOW_INFORMATION_FRAGMENTS, split_lines
from quarry.session import write_table

#: Characters beyond which a document is processed by segments, lines of a segment, pieces numbered by one task.
LARGE_CHARS, SEGMENT_LINES, NUMBERED = 1 << 20, 4096, 1024
#: Lines folded into one list of blocks.
FOLD_LINES = 64

# Fixed values (the reference's chunker patterns and size bound), in Java syntax
# with Unicode character classes to match Python's str regex semantics.
CHUNK_SIZE = 500
HEADING_PATTERN = r"(?U)^\s{0,3}#{1,6}\s+.+$"
HEADING_LEVEL_PATTERN = r"(?U)^\s{0,3}(#{1,6})\s+"
FENCE_PATTERN = r"(?U)^\s{0,3}(`{3,}|~{3,})"
LIST_ITEM_PATTERN = r"(?U)^\s*(?:[-*+]\s+|\d+[.)]\s+)"
HORIZONTAL_RULE_PATTERN = r"(?U)^\s{0,3}(?:(?:-\s*){3,}|(?:\*\s*){3,}|(?:_\s*){3,})$"
BLANK_PATTERN = r"(?U)^\s*$"
SENTENCE_END = r"(?U)([.!?])\s+"
# A line break, so no line holds it.
SENTENCE_MARK = "\x1c"
# Lines that match none of the patterns above, tried in one go.
PLAIN_PATTERN = r"(?U)^(?!\s*(?:[-*+#_`~]|\d|$))"
WORD_SPLIT = r"(?U)\s+"
# What (?U)\s matches.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _strip(c: Column) -> Column:
    spaces = list(SPACES)
    return F.when(F.substring(c, 1, 1).isin(spaces) | F.substring(c, -1, 1).isin(spaces), F.btrim(c, F.lit(SPACES))).otherwise(c)


def _last(expr: Column, w) -> Column:
    return F.last(expr, ignorenulls=True).over(w)


def classify_lines(files: DataFrame, segment_lines: int, path_col: str = "source_path", text_col: str = "content") -> DataFrame:
    """(source_path, ln, line, seg) plus the raw pattern flags, by segment of a document."""
    lines = files.select(path_col, F.posexplode(split_lines(F.col(text_col))).alias("ln", "line"))
    lines = lines.withColumn("seg", F.floor(F.col("ln") / segment_lines)).repartition(path_col, "seg")
    return lines.select(
        *[c for c in lines.columns],
        F.col("line").rlike(HEADING_PATTERN).alias("is_heading"),
        F.length(F.regexp_extract("line", HEADING_LEVEL_PATTERN, 1)).alias("level"),
        F.col("line").rlike(FENCE_PATTERN).alias("is_fence"),
        F.col("line").rlike(LIST_ITEM_PATTERN).alias("is_list"),
        F.col("line").rlike(HORIZONTAL_RULE_PATTERN).alias("is_rule"),
        F.col("line").rlike(BLANK_PATTERN).alias("is_blank"),
    )


def _line_kinds(lines: DataFrame, fences: Column) -> DataFrame:
    """Fence state and separators, from the number of fence lines before each line."""
    x = lines.withColumn("in_fence", fences % 2 == 1)
    return (x.withColumn("eff_heading", F.col("is_heading") & ~F.col("in_fence"))
            .withColumn("eff_rule", F.col("is_rule") & ~F.col("in_fence") & ~F.col("eff_heading"))
            .withColumn("hard", F.col("eff_heading") | F.col("eff_rule"))
            .withColumn("sep", F.col("hard") | (F.col("is_blank") & ~F.col("in_fence"))))


def _with_context(x: DataFrame) -> DataFrame:
    """``context`` from the place (_hp1.._hp6) and text (_ht1.._ht6) of the last heading of each level."""
    alive = []
    for lv in range(1, 7):
        shallower = [F.coalesce(F.col(f"_hp{s}"), F.lit(-1)) for s in range(1, lv)]
        cond = F.col(f"_hp{lv}").isNotNull()
        if shallower:
            cond = cond & (F.col(f"_hp{lv}") > F.greatest(*shallower, F.lit(-1)))
        alive.append(F.when(cond, F.col(f"_ht{lv}")))
    x = x.withColumn("context", F.array_join(F.array_compact(F.array(*alive)), "\n"))
    return x.drop(*[f"_hp{lv}" for lv in range(1, 7)], *[f"_ht{lv}" for lv in range(1, 7)])


def _marks(lines: Column) -> Column:
    """What each line is, with its number and, of a heading, level and text."""
    def mark(line: Column, i: Column) -> Column:
        def kinds(level, heading, fence, is_list, rule, blank) -> Column:
            return F.struct(i.alias("ln"), level.cast("int").alias("level"), heading.cast("string").alias("heading"), fence.alias("fence"),
                            is_list.alias("list"), rule.alias("rule"), blank.alias("blank"))

        no, is_heading = F.lit(False), line.rlike(HEADING_PATTERN)
        return (F.when(line.rlike(PLAIN_PATTERN), kinds(F.lit(0), F.lit(None), no, no, no, no))
                .when(is_heading, kinds(F.length(F.regexp_extract(line, HEADING_LEVEL_PATTERN, 1)), _strip(line), no, no, no, no))
                .otherwise(kinds(F.lit(0), F.lit(None), line.rlike(FENCE_PATTERN), line.rlike(LIST_ITEM_PATTERN),
                                 line.rlike(HORIZONTAL_RULE_PATTERN), line.rlike(BLANK_PATTERN))))
    return F.transform(lines, mark)


#: State of the fold: inside a fence, last heading of each level; the block begun (first and last line, list, context), whether
#: its run goes on, has a list, and no hard break followed; blocks of these FOLD_LINES lines, and the lists before.
BLOCK = "struct<first: int, last: int, list: boolean, context: string>"
STATE = {"fence": "boolean", "heads": "array<string>", "block": BLOCK, "run": "boolean", "run_list": "boolean", "soft": "boolean",
         "blocks": f"array<{BLOCK}>", "done": f"array<array<{BLOCK}>>"}


def _put(state: Column, **changed: Column) -> Column:
    return F.struct(*[changed.get(name, state[name]).cast(kind).alias(name) if name in changed else state[name].alias(name) for name, kind in STATE.items()])


def _block(first: Column, last: Column, is_list: Column, context: Column) -> Column:
    return F.struct(first.alias("first"), last.alias("last"), is_list.alias("list"), context.alias("context"))


def line_blocks(marks: Column) -> Column:
    """Blocks of a document in order: first and last line, whether one is a list item, heading context."""
    no = F.lit(False)
    none = F.array()
    zero = F.struct(*[v.cast(STATE[n]).alias(n) for n, v in {
        "fence": no, "heads": F.array(*[F.lit(None)] * 6), "block": F.lit(None), "run": no, "run_list": no, "soft": no, "blocks": none, "done": none}.items()])

    def step(s: Column, m: Column) -> Column:
        own, blocks = s["block"], s["blocks"]
        heads = F.transform(s["heads"], lambda h, i: F.when(i + 1 < m["level"], h).when(i + 1 == m["level"], m["heading"]))
        joins = s["soft"] & s["run_list"] & m["list"]
        more = _block(own["first"], m["ln"], own["list"] | m["list"], own["context"])
        fresh = _block(m["ln"], m["ln"], m["list"], F.array_join(s["heads"], "\n"))
        fence = s["fence"] != m["fence"]
        return (F.when(~s["fence"] & (m["level"] > 0), _put(s, heads=heads, run=no, soft=no))
                .when(~s["fence"] & m["rule"], _put(s, run=no, soft=no))
                .when(~s["fence"] & m["blank"], _put(s, run=no))
                .when(s["run"], _put(s, fence=fence, block=more, run_list=s["run_list"] | m["list"]))
                .when(joins, _put(s, fence=fence, block=more, run=F.lit(True)))
                .otherwise(_put(s, fence=fence, block=fresh, run=F.lit(True), run_list=m["list"], soft=F.lit(True),
                                blocks=F.when(own.isNull(), blocks).otherwise(F.concat(blocks, F.array(own))))))

    parts = F.transform(F.sequence(F.lit(0), F.floor(F.size(marks) / FOLD_LINES).cast("int")), lambda i: F.slice(marks, i * FOLD_LINES + 1, FOLD_LINES))
    folded = F.aggregate(parts, zero, lambda s, part: F.aggregate(
        part, s, step, lambda t: _put(t, blocks=none, done=F.concat(t["done"], F.array(t["blocks"])))),
        lambda s: F.struct(s["block"].alias("block"), s["done"].alias("done")))
    return F.flatten(F.concat(folded["done"], F.array(F.filter(F.array(folded["block"]), lambda b: b.isNotNull()))))


def block_texts(lines: Column, blocks: Column) -> Column:
    """(text, atomic, context) of the blocks that have substance."""
    def text(b: Column) -> Column:
        return F.array_join(F.slice(lines, b["first"] + 1, b["last"] - b["first"] + 1), "\n")

    # One step a ``transform``: an expression that a lambda names twice is made twice.
    rest = ("list", "context")
    made = F.transform(blocks, lambda b: F.struct(text(b).alias("text"), *[b[n].alias(n) for n in rest]))
    made = F.transform(made, lambda b: F.struct(_strip(b["text"]).alias("text"), *[b[n].alias(n) for n in rest]))
    made = F.transform(made, lambda b: F.struct(_substance(b["text"]).alias("substance"), *[b[n].alias(n) for n in ("text", *rest)]))
    return F.transform(F.filter(made, lambda b: _counts(b["substance"])), lambda b: F.struct(b["text"].alias("text"), (b["text"].rlike(FENCE_PATTERN) | b["list"]).alias("atomic"), b["context"].alias("context")))


def _carried(x: DataFrame, path_col: str, sums: dict | None = None, lasts: dict | None = None, nexts: dict | None = None) -> DataFrame:
    """``x`` with, a line, what the segments before its own pass on: _c_<name> of the ``sums`` (a column added up) and the
    ``lasts`` (value, condition: the value at the last line that meets it); of ``nexts`` what those after it pass back."""
    sums, lasts, nexts = sums or {}, lasts or {}, nexts or {}
    key = [path_col, "seg"]
    summary = x.groupBy(*key).agg(
        *[F.sum(c).alias(n) for n, c in sums.items()],
        *[F.max_by(v, F.when(cond, F.col("ln"))).alias(n) for n, (v, cond) in lasts.items()],
        *[F.min_by(v, F.when(cond, F.col("ln"))).alias(n) for n, (v, cond) in nexts.items()])
    above = Window.partitionBy(path_col).orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    below = Window.partitionBy(path_col).orderBy(F.desc("seg")).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(
        *key, *[F.coalesce(F.sum(n).over(above), F.lit(0)).alias(f"_c_{n}") for n in sums],
        *[_last(F.col(n), above).alias(f"_c_{n}") for n in lasts], *[_last(F.col(n), below).alias(f"_c_{n}") for n in nexts])
    return x.join(carry, key)


def segment_blocks_carried(lines: DataFrame, path_col: str = "source_path") -> DataFrame:
    """Lines that belong to a block, with block id and heading context, from lines with ``seg``: each window runs over one segment."""
    doc = Window.partitionBy(path_col, "seg").orderBy("ln")
    before = doc.rowsBetween(Window.unboundedPreceding, -1)
    upto = doc.rowsBetween(Window.unboundedPreceding, 0)
    after = (Window.partitionBy(path_col, "seg").orderBy(F.col("ln").desc())
             .rowsBetween(Window.unboundedPreceding, -1))
    ln, levels = F.col("ln"), range(1, 7)

    def since(value: Column, frame, name: str) -> Column:
        return F.coalesce(_last(value, frame), F.col(f"_c_{name}"))

    x = _carried(write_table(lines, "lines"), path_col, sums={"fences": F.col("is_fence").cast("int")})
    x = _line_kinds(x, F.col("_c_fences") + F.coalesce(F.sum(F.col("is_fence").cast("int")).over(before), F.lit(0)))
    x = write_table(x.drop("_c_fences"), "line-kinds")

    heading = {lv: F.col("eff_heading") & (F.col("level") == lv) for lv in levels}
    text, run = _strip(F.col("line")), ~F.col("sep")
    lasts = {**{f"hp{lv}": (ln, heading[lv]) for lv in levels}, **{f"ht{lv}": (text, heading[lv]) for lv in levels},
             "sep": (ln, F.col("sep")), "list": (ln, F.col("is_list") & run), "end": (ln, run), "hard": (ln, F.col("hard")),
             "was_sep": (F.col("sep"), F.lit(True))}
    x = _carried(x, path_col, lasts=lasts)
    for lv in levels:
        x = (x.withColumn(f"_hp{lv}", since(F.when(heading[lv], ln), upto, f"hp{lv}"))
             .withColumn(f"_ht{lv}", since(F.when(heading[lv], text), upto, f"ht{lv}")))
    x = _with_context(x)
    sep_ln = since(F.when(F.col("sep"), ln), upto, "sep")
    list_ln = since(F.when(F.col("is_list") & run, ln), upto, "list")
    x = x.withColumn("run_has_list", F.when(run, F.coalesce(list_ln, F.lit(-1)) > F.coalesce(sep_ln, F.lit(-1))))
    x = x.withColumns({"prev_end": since(F.when(run, ln), before, "end"), "last_hard": since(F.when(F.col("hard"), ln), before, "hard"),
                       "prev_sep": F.coalesce(F.lag("sep").over(doc), F.col("_c_was_sep"), F.lit(True))})
    x = write_table(x.drop(*[c for c in x.columns if c.startswith("_c_")]), "line-runs")

    x = _carried(x, path_col, lasts={"had_list": (F.col("run_has_list"), run)})
    prev_list = since(F.when(run, F.col("run_has_list")), before, "had_list")
    run_start = run & F.col("prev_sep")
    joins = (run_start & F.col("prev_end").isNotNull() & (F.coalesce("last_hard", F.lit(-1)) < F.col("prev_end"))
             & F.coalesce(prev_list, F.lit(False)) & F.col("is_list"))
    x = x.withColumn("joins", F.when(run, joins))
    x = x.withColumn("block_start", (run_start & ~F.coalesce(F.col("joins"), F.lit(False))).cast("int"))
    x = write_table(x.drop("_c_had_list"), "line-blocks")

    x = _carried(x, path_col, sums={"blocks": F.col("block_start")}, nexts={"joined": (F.col("joins"), run)})
    x = x.withColumn("block_id", F.col("_c_blocks") + F.sum("block_start").over(upto))
    next_joins = F.coalesce(_last(F.when(run, F.col("joins")), after), F.col("_c_joined"))
    x = x.withColumn("keep_blank", F.col("is_blank") & ~F.col("in_fence") & F.coalesce(next_joins, F.lit(False)))
    return x.where(run | F.col("keep_blank")).select(path_col, "ln", "line", "is_list", "block_id", "context")


def _pack(units: Column) -> Column:
    """Greedy fold: append a unit while the piece stays within CHUNK_SIZE, else start a new piece."""
    init = F.struct(F.array().cast("array<string>").alias("pieces"), F.lit(None).cast("string").alias("cur"))

    def step(acc, u):
        fits = F.length(acc["cur"]) + 1 + F.length(u) <= CHUNK_SIZE
        return (F.when(acc["cur"].isNull(), F.struct(acc["pieces"].alias("pieces"), u.alias("cur")))
                .when(fits, F.struct(acc["pieces"].alias("pieces"), F.concat(acc["cur"], F.lit(" "), u).alias("cur")))
                .otherwise(F.struct(F.concat(acc["pieces"], F.array(acc["cur"])).alias("pieces"), u.alias("cur"))))

    return F.aggregate(units, init, step,
                       lambda acc: F.when(acc["cur"].isNull(), acc["pieces"])
                       .otherwise(F.concat(acc["pieces"], F.array(acc["cur"]))))


def _substance(text: Column) -> Column:
    """The lines of a block's text that are neither blank, heading nor rule."""
    substantive = F.filter(F.split(text, "\n"),
                           lambda ln: ln.rlike(PLAIN_PATTERN) | (~ln.rlike(BLANK_PATTERN) & ~ln.rlike(HEADING_PATTERN)
                                                                 & ~ln.rlike(HORIZONTAL_RULE_PATTERN)))
    return F.array_join(substantive, " ")


def _counts(substance: Column) -> Column:
    """Whether there is a line, and the lines are not one low-information word."""
    long = max(map(len, LOW_INFORMATION_FRAGMENTS))
    word = _strip(substance)
    return (F.length(substance) > 0) & ((F.length(word) > long) | ~F.lower(word).isin(*LOW_INFORMATION_FRAGMENTS))


def emit_blocks(blocks: DataFrame, path_col: str = "source_path") -> DataFrame:
    """Block text, substance filter, atomic rule; one row per block that survives."""
    agg = (blocks.groupBy(path_col, "block_id")
           .agg(F.sort_array(F.collect_list(F.struct("ln", "line"))).alias("ls"),
                F.max(F.col("is_list").cast("int")).alias("has_list"),
                F.first("context").alias("context")))
    text = _strip(F.array_join(F.transform("ls", lambda s: s["line"]), "\n"))
    b = agg.select(path_col, "block_id", "context", "has_list", text.alias("text")).where(F.length("text") > 0)
    b = b.where(_counts(_substance(F.col("text"))))
    atomic = F.col("text").rlike(FENCE_PATTERN) | (F.col("has_list") == 1)
    return b.withColumn("atomic", atomic)


def split_long(text: Column) -> Column:
    """Pieces of a prose block: sentences packed greedily to CHUNK_SIZE; an oversize
    sentence flushes the current piece and is word-packed on its own (one fold, with a
    nested fold for the words), so a block never leaves its row."""
    init = F.struct(F.array().cast("array<string>").alias("pieces"), F.lit(None).cast("string").alias("cur"))

    def step(acc, s):
        flushed = F.when(acc["cur"].isNull(), acc["pieces"]).otherwise(F.concat(acc["pieces"], F.array(acc["cur"])))
        words = _pack(F.filter(F.split(s, WORD_SPLIT), lambda w: w != ""))
        fits = F.length(acc["cur"]) + 1 + F.length(s) <= CHUNK_SIZE
        return (F.when(F.length(s) > CHUNK_SIZE,
                       F.struct(F.concat(flushed, words).alias("pieces"), F.lit(None).cast("string").alias("cur")))
                .when(acc["cur"].isNull(), F.struct(acc["pieces"].alias("pieces"), s.alias("cur")))
                .when(fits, F.struct(acc["pieces"].alias("pieces"), F.concat(acc["cur"], F.lit(" "), s).alias("cur")))
                .otherwise(F.struct(F.concat(acc["pieces"], F.array(acc["cur"])).alias("pieces"), s.alias("cur"))))

    return F.aggregate(F.split(F.regexp_replace(text, SENTENCE_END, "$1" + SENTENCE_MARK), SENTENCE_MARK), init, step,
                       lambda acc: F.when(acc["cur"].isNull(), acc["pieces"])
                       .otherwise(F.concat(acc["pieces"], F.array(acc["cur"]))))


def split_pieces(blocks: DataFrame, path_col: str = "source_path") -> DataFrame:
    """Block -> pieces of at most CHUNK_SIZE (whole words; an oversize word stays whole);
    atomic blocks and blocks of at most CHUNK_SIZE characters stay whole."""
    return blocks.select(path_col, "block_id", "context",
                         F.posexplode(_pieces(F.col("text"), F.col("atomic"))).alias("piece", "piece_text"))


def _pieces(text: Column, atomic: Column) -> Column:
    return F.when(atomic | (F.length(text) <= CHUNK_SIZE), F.array(text)).otherwise(split_long(text))


def _content(context: Column, piece: Column) -> Column:
    return F.when(context != "", F.concat(context, F.lit("\n\n"), piece)).otherwise(piece)


def _chunks_of_large(files: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """Chunks of documents whose lines, blocks and pieces are shared by many tasks."""
    files = files.select(F.struct(path_col).alias(path_col), text_col)  # joins then meet null paths too
    lines = classify_lines(files, SEGMENT_LINES, path_col, text_col)
    blocks = emit_blocks(segment_blocks_carried(lines, path_col), path_col)
    pieces = write_table(split_pieces(blocks, path_col).withColumn("part", F.floor(F.col("block_id") / NUMBERED)), "pieces")
    counts = pieces.groupBy(path_col, "part").agg(F.count(F.lit(1)).alias("n"))
    above = Window.partitionBy(path_col).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(path_col, "part", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy(path_col, "part").orderBy("block_id", "piece"))
    return (pieces.withColumn("place", place).join(base, [path_col, "part"])
            .select(F.col(path_col)[path_col].alias(path_col), (F.col("base") + F.col("place") - 1).cast("int").alias("chunk_index"), _content(F.col("context"), F.col("piece_text")).alias("content")))


def chunk_markdown(files: DataFrame, path_col: str = "source_path", text_col: str = "content") -> DataFrame:
    """Markdown files -> (source_path, chunk_index, content), chunk_index from 0 in document order."""
    chars, path = F.char_length(text_col), F.col(path_col)
    small = files.where(chars <= LARGE_CHARS)
    of_path = files.groupBy(path_col).agg(F.max(chars).alias("most"), F.count(F.when(chars <= LARGE_CHARS, 1)).alias("small"))
    sizes = of_path.agg(F.max("most").alias("most"), F.max("small").alias("small")).first()
    parts = []
    if (sizes["most"] or 0) > LARGE_CHARS:
        parts.append(_chunks_of_large(files.where(chars > LARGE_CHARS), path_col, text_col))
    if (sizes["small"] or 0) > 1:
        shared = small.groupBy(path_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(path.alias("_shared"))
        parts.append(_chunks_of_large(small.join(shared, path.eqNullSafe(F.col("_shared")), "left_semi"), path_col, text_col))
        small = small.join(shared, path.eqNullSafe(F.col("_shared")), "left_anti")
    held = small.repartition(path_col).select(path_col, split_lines(text_col).alias("lines")).withColumn("marks", _marks(F.col("lines")))
    held = held.select(path_col, "lines", line_blocks(F.col("marks")).alias("blocks"))
    texts = held.select(path_col, block_texts(F.col("lines"), F.col("blocks")).alias("texts"))
    pieces = F.flatten(F.transform("texts", lambda b: F.transform(_pieces(b["text"], b["atomic"]), lambda p: _content(b["context"], p))))
    # The outer form, since the plain one makes its array twice, once to leave out empty ones.
    chunks = texts.select(path_col, F.posexplode_outer(pieces).alias("chunk_index", "content")).where("chunk_index IS NOT NULL")
    return reduce(DataFrame.unionByName, parts, chunks)
