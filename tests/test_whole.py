"""Queries that once covered a part of their tables cover all rows and whole texts."""

from pyspark.sql import functions as F
from test_queries import SF

from corpusmill.operators import corpus
from corpusmill.plans import registry


def test_shift_similarity_covers_all_vectors(spark):
    assert registry.queries()["shift_similarity"](spark, SF).count() == spark.read.parquet(f"{SF}/embeddings.parquet").count()


def test_song_sheets_have_whole_texts(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("text is not null").collect()}
    found = {r.track_id: r.sheet for r in registry.queries()["song_sheets"](spark, SF).collect()}
    assert set(found) == set(texts) and any(len(t) > 1000 for t in texts.values())
    for i, t in texts.items():
        assert all(f"- {x}  _(" in found[i] for x in t.split("\n"))


def test_unstratified_split_numbers_cells(spark):
    """In the order of one window over all rows, which the plan does not have."""
    rows = spark.range(500).select(F.col("id").alias("g"))
    got = corpus.ratio_split(rows, "g", (0.8, 0.1, 0.1), 7)
    want = corpus.ratio_split(rows, "g", (0.8, 0.1, 0.1), 7, F.lit("x"))
    assert {(r.g, r.split) for r in got.collect()} == {(r.g, r.split) for r in want.collect()}
    assert "_cell" in got._jdf.queryExecution().optimizedPlan().toString()
