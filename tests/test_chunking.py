"""Chunker: hand cases, conservation of words, and equality with the run / join rule over whole files."""

import random

import brute
from conftest import SF_SMALL
from pyspark.sql import functions as F

from quarry.functions.text import split_lines
from quarry.operators import chunking
from quarry.operators.chunking import chunk_markdown
from quarry.plans import fixtures as fx

FENCE = "```"


def run(spark, texts):
    df = spark.createDataFrame([(f"doc{i}.md", t) for i, t in enumerate(texts)], "source_path string, content string")
    out = {}
    for r in chunk_markdown(df).collect():
        out.setdefault(r.source_path, {})[r.chunk_index] = r.content
    return [[out.get(f"doc{i}.md", {})[j] for j in range(len(out.get(f"doc{i}.md", {})))] for i in range(len(texts))]


def test_hand_cases(spark):
    cases = [
        "# Rivers\nWater runs downhill.\n\n## Deltas\nSilt settles.\n\nBirds nest here.",
        f"# Tools\n\n1. hammer\n\n2) saw\n\n{FENCE}sql\nselect 1\n\nselect 2\n{FENCE}",
        "# Glue\n\nTherefore",
        "# Ice\n\n## Motion\n\n***\n\nGlaciers creep under their own weight.",
        "# Tides\n\n" + "The moon pulls the sea twice a day. " * 25,
        "## Wind\nAir moves.\n# Sand\nDunes follow.",
    ]
    got = run(spark, cases)
    assert got[0] == ["# Rivers\n\nWater runs downhill.", "# Rivers\n## Deltas\n\nSilt settles.",
                      "# Rivers\n## Deltas\n\nBirds nest here."]
    assert got[1] == ["# Tools\n\n1. hammer\n\n2) saw", f"# Tools\n\n{FENCE}sql\nselect 1\n\nselect 2\n{FENCE}"]
    assert got[2] == []
    assert got[3] == ["# Ice\n## Motion\n\nGlaciers creep under their own weight."]
    sentence = "The moon pulls the sea twice a day."
    assert [c.count(sentence) for c in got[4]] == [13, 12]  # 13 sentences are 467 characters, 14 would be 503
    assert got[5] == ["## Wind\n\nAir moves.", "# Sand\n\nDunes follow."]
    assert got == [brute.chunk(t) for t in cases]


def test_no_word_is_lost_and_pieces_fit(spark):
    rng = random.Random(5)
    texts = ["\n\n".join(" ".join("w" * rng.randint(1, 12) + rng.choice(["", "", ".", "?"])
                                  for _ in range(rng.randint(2, 300))) for _ in range(6)) for _ in range(8)]
    for text, pieces in zip(texts, run(spark, texts)):
        assert " ".join(pieces).split() == text.split()
        assert max(map(len, pieces)) <= 500


def test_edge_cases_match_rule(spark):
    cases = [
        "",
        "\n\n\n",
        "plain line",
        "# A\n## B\n### C\ntext\n## D\nmore",
        "# A\n```\n# not a heading\n\n---\n```\nafter",
        "- a\n- b\n\n\n- c\n\ntext after\n\n1. one\n2) two",
        "Title\n---\nbody",
        "* * *\n\n- - -\n\n- item\n\n- - -\n\n- next",
        "~~~\nunclosed fence\n\n# still code",
        "x" * 1200,
        ("word " * 150 + ". ") * 3 + "Short one. " + "y" * 600 + " tail.",
        "   # indented heading\ntext\n    # code heading\n",
        "line\r\nwith crlf\r\n\r\nnext",
        "a b\x0bc\x0cd\x1ce\x85f",
    ]
    assert run(spark, cases) == [brute.chunk(t) for t in cases]


def test_corpus_matches_rule(spark):
    files = fx.markdown_files(spark, SF_SMALL)
    got = {}
    for r in chunk_markdown(files).collect():
        got.setdefault(r.source_path, {})[r.chunk_index] = r.content
    for r in files.collect():
        g = got.get(r.source_path, {})
        assert [g[i] for i in range(len(g))] == brute.chunk(r.content), r.source_path


def test_segments_match_rule(spark, monkeypatch):
    """Documents cut into segments of a few lines: same chunks as line by line."""
    rng = random.Random(3)
    pieces = ["# H1", "## H2", "### H3 ", "text here", "more text, longer than the others.", "", "", "- item", "1. one", "```", "---", "   ", "word " * 130, "where", "~~~ x"]
    texts = ["\n".join(rng.choice(pieces) for _ in range(rng.randint(20, 160))) for _ in range(25)]
    texts += ["```\n" + "\n\n".join(f"line {i}" for i in range(40)), "- a\n" + "\n" * 30 + "- b\n\n- c", "\n" * 60 + "end", "# A\n" + "b\n" * 50]
    want = [brute.chunk(t) for t in texts]
    monkeypatch.setattr(chunking, "LARGE_CHARS", 30)
    for lines in (3, 7):
        monkeypatch.setattr(chunking, "SEGMENT_LINES", lines)
        monkeypatch.setattr(chunking, "NUMBERED", lines)
        assert run(spark, texts) == want


def test_lines_are_not_sorted_or_shuffled(spark):
    """A document of few characters is one row until its chunks go out: no window, no sort, one shuffle."""
    df = spark.createDataFrame([("a.md", "# A\n\ntext")], "source_path string, content string")
    plan = chunk_markdown(df)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and " Sort " not in plan and plan.count("Exchange") == 1


def test_files_of_one_path_are_one_document(spark):
    """Equal and null paths: the files' lines by number, in one document with one numbering."""
    rows = [("twice.md", "# A\n\nb\n\nc"), ("twice.md", "# A\n\nb\n\nc"), (None, "x\n\ny"), (None, "x\n\ny"), ("no.md", None), ("one.md", "z")]
    df = spark.createDataFrame(rows, "source_path string, content string")
    want = {("twice.md", i, c) for i, c in enumerate(brute.chunk("# A\n# A\n\n\nb\nb\n\n\nc\nc"))} | {(None, 0, "x\nx"), (None, 1, "y\ny"), ("one.md", 0, "z")}
    got = [tuple(r) for r in chunk_markdown(df).collect()]
    assert len(got) == len(want) and set(got) == want


def test_strip_and_lines_of_any_break(spark):
    spaces = [chr(i) for i in range(1, 0x3100)]
    df = spark.createDataFrame([(c,) for c in spaces], "c string")
    padded = F.concat("c", F.lit("a"), "c")
    assert df.where(chunking._strip(padded) != F.regexp_replace(padded, r"(?U)^\s+|\s+$", "")).count() == 0
    texts = ["", "\n", "a", "a\n", "a\r\nb", "a\x1cb\x85", "\u2028", "a\r\r\n\nb\u2029", "é\x0b\x0cz\n\n"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", split_lines("t").alias("x")).collect()
    assert [(r.t, r.x) for r in got] == [(t, t.splitlines()) for t in texts]
