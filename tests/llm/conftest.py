import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "the of and in is that from with near over stone river market letter winter cloud garden silver engine paper".split()
LOREM = {"en": WORDS, "de": "der die und ein nicht mit für über straße größe schön haus garten winter brief wolke".split()}


def prose(seed, n, lang="en"):
    r = random.Random(seed)
    return " ".join(r.choice(LOREM[lang]) + str(r.choice(["", "", "s", "ing", "er"])) for _ in range(n))


@pytest.fixture(scope="session")
def docs(spark):
    """Copies, near copies, shared passages, null, empty, wordless and long texts, repeated rows, null columns."""
    base = [prose(i, 40 + i % 7 * 30) for i in range(40)]
    passage = prose("shared", 30)
    rows = [(i, t, "en", f"src{i % 3}", None) for i, t in enumerate(base)]
    rows += [(100 + i, base[i].upper() if i % 2 else base[i], "en", "src0", 1) for i in range(8)]  # equal but for case
    rows += [(200 + i, base[9] + f" extra{i}", None, None, 1) for i in range(6)]  # near copies
    rows += [(300 + i, prose(f"a{i}", 20) + " " + passage + " " + prose(f"b{i}", 20), "en", "src1", 1) for i in range(5)]
    rows += [(400 + i, prose(f"d{i}", 50, "de"), "de", "src2", 1) for i in range(30)]
    rows += [(500, None, "en", "src1", None), (501, "", "en", "src1", 0), (502, " \t\n ", None, "src1", 3), (503, "123 !!", "en", None, 6),
             (504, "one", "en", "src2", 3), (505, prose("long", 30_000), "en", "src2", 1), (506, "=" * 300, None, "src2", 300),
             (507, "don't <|endoftext|> İı 中文 á \x00 ☃", "en", "src0", 1), (None, base[3], "en", "src0", 1), (None, "alone " * 30, "en", "src0", 1)]
    rows += [rows[5], rows[5]]  # repeated in full
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same rows with further columns named like those the operators add."""
    from pyspark.sql import functions as F
    out = docs
    for c in ("id", "fp", "component_id", "score", "lang_pred", "held_out", "size", "taken", "start", "length", "block", "row", "digest",
              "keep_id", "kept", "predicted", "quality", "part", "seq", "ids", "_text", "sequence_id", "offset", "copies", "license"):
        out = out.withColumn(c, F.lit("x"))
    return out


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
