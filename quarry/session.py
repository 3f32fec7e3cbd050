"""Session construction and cluster-safe checkpoint handling."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "quarry", extra: dict | None = None) -> SparkSession:
    """Session used by tests, bench and the entry point.

    On a cluster the master and most settings come from ``spark-submit``; the
    values here only fill gaps for local runs.
    """
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.appName(app)
    builder = builder.master(master or f"local[{cpus}]")
    conf = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions or 8),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g",
    }
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``quarry`` importable in Python workers (UDFs, mapInArrow, state functions):
    zip the package once per SparkContext and add it with ``addPyFile``, which
    distributes it to every executor."""
    sc = spark.sparkContext
    if id(sc) in _SHIPPED:
        return
    import shutil
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="quarry-pkg-")
    archive = shutil.make_archive(os.path.join(out, "quarry"), "zip", os.path.dirname(pkg), "quarry")
    sc.addPyFile(archive)
    _SHIPPED.add(id(sc))


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster must name a shared folder.  Only a local session (tests, bench)
    with no setting gets a fresh scratch folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not _is_local(spark):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="quarry-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", configured)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    ship_package(spark)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss); never a local checkpoint."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def write_table(df: DataFrame, name: str = "table") -> DataFrame:
    """Cut lineage by writing a parquet table into the shared checkpoint folder and
    reading it back (columnar, compressed, with file statistics for the planner)."""
    import uuid
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def bounded(df: DataFrame, max_rows: int = 2_000_000, max_bytes: int = 256 << 20) -> DataFrame:
    """Materialise ``df``; the result is marked for broadcast when its counted rows and measured
    bytes are within the bounds, else it is left to a shuffle join."""
    from pyspark.sql import functions as F
    m = cut_lineage(df)
    nested = ("string", "binary", "array", "map", "struct")
    width = F.lit(16 * len(m.columns))
    for c, kind in m.dtypes:
        if kind.startswith(nested):
            width = width + F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0))
    size = m.agg(F.count(F.lit(1)).alias("n"), F.sum(width.cast("bigint")).alias("b")).head()
    return F.broadcast(m) if size["n"] <= max_rows and (size["b"] or 0) <= max_bytes else m
