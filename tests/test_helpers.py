"""Seeded choices, embedder hook, dimension check, vector text codec."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import embedding as em
from quarry.operators import schedule as sc


def test_choose_topic_and_angle(spark):
    sessions = spark.createDataFrame([(i,) for i in range(50)], "session_id long")
    topics = spark.createDataFrame([(0, "intro"), (1, "python/basics"), (2, "sql")], "topic_no long, topic string")
    a = {r.session_id: r.topic for r in sc.choose_topic(sessions, topics, seed=3).collect()}
    b = {r.session_id: r.topic for r in sc.choose_topic(sessions, topics, seed=3).collect()}
    assert a == b and len(a) == 50 and set(a.values()) <= {"intro", "python/basics", "sql"}
    assert len(set(a.values())) > 1
    with pytest.raises(RuntimeError):
        sc.choose_topic(sessions, topics.limit(0))
    angles = {r.a for r in sessions.select(sc.choose_angle(F.col("session_id")).alias("a")).collect()}
    assert angles <= set(sc.QUESTION_ANGLES) and len(angles) > 1


def test_embed_with_model_and_dimension_check(spark):
    df = spark.createDataFrame([("a b",), ("c",)], "t string")

    def load():
        return lambda texts: np.array([[len(t), 1.0, 0.0] for t in texts])

    out = em.embed_with(df, "t", load, dim=3).collect()
    assert [list(r.embedding) for r in out] == [[3.0, 1.0, 0.0], [1.0, 1.0, 0.0]]
    with pytest.raises(Exception, match="dimension"):
        em.embed_with(df, "t", load, dim=4).collect()
    v = spark.createDataFrame([([1.0, 2.0],)], "embedding array<float>")
    assert em.check_dimension(v, "embedding", 2).count() == 1
    with pytest.raises(Exception, match="dimension"):
        em.check_dimension(v, "embedding", 3).collect()


def test_vector_text_codec(spark):
    v = spark.createDataFrame([([1.5, -2.0, 0.25],)], "embedding array<float>")
    s = v.select(em.vector_to_string("embedding").alias("s")).head().s
    assert s == "[1.5,-2.0,0.25]"
    back = v.select(em.string_to_vector(em.vector_to_string("embedding")).alias("b")).head().b
    assert list(back) == [1.5, -2.0, 0.25]


def test_hashing_embedder_counts(spark):
    df = spark.createDataFrame([("Cat cat dog",), ("",), (None,)], "t string")
    rows = em.embed_hashing(df, "t", dim=16).collect()
    assert sum(rows[0].embedding) == 3.0 and max(rows[0].embedding) == 2.0
    assert sum(rows[1].embedding) == 0.0
    assert rows[2].embedding is None
