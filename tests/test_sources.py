"""Markdown folder source, topics, sinks."""

import json
import os
import tempfile

from quarry.sources.markdown import list_topics, read_markdown
from quarry.sources.sinks import append_usage, to_json_lines


def test_read_markdown_and_topics(spark):
    root = tempfile.mkdtemp(prefix="quarry-md-", dir="/tmp")
    os.makedirs(f"{root}/python")
    with open(f"{root}/python/basics.md", "wb") as fh:
        fh.write("# Title\r\nbody é\r\n".encode("utf-8"))
    with open(f"{root}/intro.md", "w") as fh:
        fh.write("intro")
    with open(f"{root}/notes.txt", "w") as fh:
        fh.write("not markdown")
    files = read_markdown(spark, root)
    rows = {os.path.relpath(r.source_path, root): r.content for r in files.collect()}
    assert rows == {"python/basics.md": "# Title\nbody é\n", "intro.md": "intro"}
    assert [r.topic for r in list_topics(files, root).collect()] == ["intro", "python/basics"]


def test_sinks(spark):
    import datetime
    out = tempfile.mkdtemp(prefix="quarry-sink-", dir="/tmp")
    df = spark.createDataFrame([("r1", datetime.datetime(2024, 1, 2, 3), 5)], "response_id string, created_at timestamp, n int")
    append_usage(df, f"{out}/usage")
    append_usage(df, f"{out}/usage")
    back = spark.read.parquet(f"{out}/usage")
    assert back.count() == 2 and "created_date" in back.columns
    line = to_json_lines(df.select("response_id", "n")).head().value
    assert json.loads(line) == {"response_id": "r1", "n": 5}
