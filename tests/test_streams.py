"""Streams equal their batch jobs, on one file and on folders of shuffled part files."""

import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

import __spark_entry__ as entry_mod
from quarry.operators import accounting as acc
from quarry.operators import sessions as ss
from quarry.operators.chunking import chunk_markdown
from quarry.plans import fixtures as fx

TABLES = ("lineitem", "events", "documents", "labels")


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture(scope="module")
def many_files(spark, tmp_path_factory):
    """The small tables as folders of four part files, rows dealt out at random."""
    root = str(tmp_path_factory.mktemp("many"))
    for name in TABLES:
        (spark.read.parquet(f"{SF_SMALL}/{name}.parquet").repartition(4, F.rand(7))
         .write.parquet(f"{root}/{name}.parquet"))
    return root


@pytest.fixture(params=["one", "many"])
def sf(request, many_files):
    return SF_SMALL if request.param == "one" else many_files


def _rows(df):
    return sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


def test_first_answers(spark, sf):
    s = entry_mod.queries()["stream_first_answers"](spark, sf)
    assert _rows(s) == _rows(fx.answers(spark, sf).select(*s.columns))


def test_difficulty_and_counters(spark, sf):
    qs, answers = entry_mod.queries(), fx.answers(spark, sf)
    assert _rows(qs["stream_difficulty"](spark, sf)) == _rows(ss.difficulty_path(answers))
    assert _rows(qs["stream_session_counters"](spark, sf)) == _rows(ss.session_counters(answers))


def test_usage_has_every_hour(spark, sf):
    s = entry_mod.queries()["stream_usage_hourly"](spark, sf)
    b = acc.usage_cost_hourly(fx.usage(spark, sf), *fx.USAGE_RANGE)
    assert _rows(s.select("time", "cost_usd")) == _rows(b)


def test_index(spark, sf):
    s = entry_mod.queries()["stream_index_refresh"](spark, sf)
    assert _rows(s) == _rows(chunk_markdown(fx.markdown_files(spark, sf)))


def test_empty_table(spark, tmp_path):
    for name in TABLES:
        df = spark.read.parquet(f"{SF_SMALL}/{name}.parquet")
        df.limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    qs = entry_mod.queries()
    for name in ("stream_first_answers", "stream_difficulty", "stream_session_counters", "stream_usage_hourly",
                 "stream_index_refresh"):
        assert qs[name](spark, str(tmp_path)).count() == 0
