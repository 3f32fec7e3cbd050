"""Versioned index, deletes by vector, rejects and constraints on small inputs."""

import os

import pytest
from pyspark.sql import functions as F

from quarry.operators import constraints, deletes, rejects, versions

INDEX = "source_path string, chunk_index int, content string"


def chunks(spark, sources, mark, n=3):
    return spark.createDataFrame([(f"s{i}", j, f"{mark}-{i}-{j}") for i in sources for j in range(n)], INDEX)


def files(spark, sources):
    return spark.createDataFrame([(f"s{i}",) for i in sources], "source_path string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def size(root):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet"))


def test_refreshes_equal_plain_replacement(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "MOST_PARTS", 3)
    root = str(tmp_path / "index")
    versions.create_index(root, chunks(spark, range(40), "v0"), buckets=4)
    want = {f"s{i}": [(f"s{i}", j, f"v0-{i}-{j}") for j in range(3)] for i in range(40)}
    for step, some in enumerate([[1, 2, 3], [2], list(range(35, 45)), [7], [2, 7, 41], [5]]):
        # A file that lost its text has no chunks; others grow or shrink.
        n = step % 3
        at = versions.refresh_index(root, files(spark, some), lambda f, s=step, n=n, some=some: chunks(spark, some, f"v{s + 1}", n))
        assert at == step + 1
        want |= {f"s{i}": [(f"s{i}", j, f"v{step + 1}-{i}-{j}") for j in range(n)] for i in some}
        assert rows(versions.read_index(spark, root)) == sorted(r for of in want.values() for r in of)
    entries = versions.manifest(spark, root)[1]
    assert max(sum(e["bucket"] == b for e in entries) for b in range(4)) <= 3


def test_refresh_writes_its_own_rows_only(spark, tmp_path):
    root = str(tmp_path / "index")
    versions.create_index(root, chunks(spark, range(2000), "text" * 50, 5), buckets=8)
    whole = size(f"{root}/chunks")
    versions.refresh_index(root, files(spark, range(20)), lambda f: chunks(spark, range(20), "new" * 50, 5))
    assert size(f"{root}/chunks") - whole < 0.15 * whole  # 1 % of the sources; small files have fixed costs
    before = size(root)
    assert versions.refresh_index(root, files(spark, []), lambda f: chunks(spark, [], "x")) == 1
    assert size(root) == before
    assert versions.reindex(root, chunks(spark, [1], "only")) == 2
    assert rows(versions.read_index(spark, root)) == [("s1", j, f"only-1-{j}") for j in range(3)]


def test_failed_and_replayed_refresh(spark, tmp_path):
    root = str(tmp_path / "index")
    versions.create_index(root, chunks(spark, range(5), "old"))
    old = rows(versions.read_index(spark, root))

    def broken(f):
        return chunks(spark, [1], "bad").withColumn("content", F.when(F.col("chunk_index") == 2, F.raise_error(F.lit("stop"))).otherwise(F.col("content")))

    with pytest.raises(Exception, match="stop"):
        versions.refresh_index(root, files(spark, [1]), broken)
    assert rows(versions.read_index(spark, root)) == old and versions.manifest(spark, root)[0] == 0
    assert versions.refresh_index(root, files(spark, [1]), lambda f: chunks(spark, [1], "new"), tag="epoch-7") == 1
    assert versions.refresh_index(root, files(spark, [1]), lambda f: chunks(spark, [1], "again"), tag="epoch-7") == 1
    assert "new-1-0" in {r[2] for r in rows(versions.read_index(spark, root))}


TABLES = [deletes.Table("users", "u"), deletes.Table("tests", "t", (("u", "users"),)), deletes.Table("answers", "a", (("t", "tests"),))]


def store(spark, root):
    deletes.store(spark.createDataFrame([(i,) for i in range(6)], "u int"), root, TABLES[0])
    deletes.store(spark.createDataFrame([(10 * i + k, i) for i in range(6) for k in range(3)], "t int, u int"), root, TABLES[1])
    deletes.store(spark.createDataFrame([(100 * t + k, t) for i in range(6) for t in range(10 * i, 10 * i + 3) for k in range(2)], "a int, t int"), root, TABLES[2])


def test_cascade_reaches_grandchildren(spark, tmp_path):
    root = str(tmp_path)
    store(spark, root)
    deletes.cascade_delete(spark, root, TABLES, "users", spark.createDataFrame([(1,), (4,), (4,), (99,)], "u int"))
    deletes.cascade_delete(spark, root, TABLES, "tests", spark.createDataFrame([(20,)], "t int"))
    kept = [0, 2, 3, 5]
    assert rows(deletes.live(spark, root, TABLES[0])) == [(u,) for u in kept]
    tests = sorted({r["t"] for r in deletes.live(spark, root, TABLES[1]).collect()})
    assert tests == [t for u in kept for t in range(10 * u, 10 * u + 3) if t != 20]
    assert sorted({r["t"] for r in deletes.live(spark, root, TABLES[2]).collect()}) == tests
    assert {r["rows"] for r in deletes.orphans(spark, root, TABLES).collect()} == {0}
    with pytest.raises(ValueError, match="unknown"):
        deletes.cascade_delete(spark, root, TABLES, "none", spark.createDataFrame([(1,)], "u int"))


def test_delete_without_cascade_leaves_orphans(spark, tmp_path):
    root = str(tmp_path)
    store(spark, root)
    deletes.cascade_delete(spark, root, TABLES[:1], "users", spark.createDataFrame([(2,)], "u int"))
    assert {(r["table"], r["rows"]) for r in deletes.orphans(spark, root, TABLES).collect()} == {("tests", 3), ("answers", 0)}


def test_split_in_one_pass(spark):
    df = spark.createDataFrame([(1, "a", 3), (2, " \t", 3), (3, None, 0), (4, "b", None), (5, "c", -1), (6, "d", 1)], "id int, query string, num_results int")
    split = rejects.split_rejects(df, rejects.search_rules())
    assert [r[0] for r in rows(split.accepted)] == [1, 6] and (split.n_accepted, split.n_rejected) == (2, 4)
    why = {r["id"]: r["reject_reason"].split()[0] for r in split.rejected.collect()}
    assert why == {2: "query", 3: "query", 4: "num_results", 5: "num_results"}
    none = rejects.split_rejects(df.limit(0), rejects.search_rules())
    assert none.accepted.count() == none.rejected.count() == none.n_accepted == 0
    good = rejects.split_rejects(df.where("id = 1"), rejects.search_rules())
    assert good.accepted.columns == df.columns and good.rejected.count() == 0


def test_constraint_counts(spark):
    df = spark.createDataFrame([(1, 3, "q"), (1, 9, None), (2, None, "r"), (3, 1, "s")], "id int, difficulty int, text string")
    got = {r["rule"]: r["violations"] for r in constraints.violations(
        df, "t", {"difficulty": constraints.between("difficulty", 1, 5), "loose": constraints.between("difficulty", 1, 5, nullable=True),
                  "text": constraints.missing("text")}, [("id",)]).collect()}
    assert got == {"t_difficulty": 2, "t_loose": 1, "t_text": 1, "t_unique_id": 1}


def test_part_files_do_not_multiply_with_tasks(spark, tmp_path):
    """A part has about as many files as buckets (or tasks, if those are more), not a file a bucket and task."""
    rows = spark.range(4000).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("source_path"), F.lit(0).alias("chunk_index"), F.lit("x").alias("content"))
    root = str(tmp_path / "index")
    versions.create_index(root, rows, buckets=8)
    assert len(list((tmp_path / "index" / "chunks").rglob("*.parquet"))) == 8
    assert versions.read_index(spark, root).count() == 4000
