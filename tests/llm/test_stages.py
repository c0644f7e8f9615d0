"""The pipeline's stages on tables with repeated and missing doc_ids, rows alike, no rows, and columns of every name they use themselves."""

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import exact_dedup, language_id, mixing, ngram_join, packing, shared

#: Names that the stages use inside, as extra columns.
NAMES = "row _row digest size cell key of at run epochs rest last here times has_words col label rep sig n share _share _shares keep_id kept best lang_pred ambiguous offset part weight level component bin cluster piece"
SCHEMA = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in NAMES.split())

STAGES = {
    "language": lambda d: language_id.keep_identified(d),
    "exact": lambda d: exact_dedup.keep_first(d),
    "near": lambda d: ngram_join.keep_one(d),
    "mix": lambda d: mixing.mixed_documents(d),
}
LONG = " ".join(f"word{k}" for k in range(60))
NEAR = LONG + " more"


def table(spark, rows):
    names = NAMES.split()
    return spark.createDataFrame([(i, t, "en", s, *names) for i, t, s in rows], SCHEMA)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "text", "source").collect()), key=str)


@pytest.mark.parametrize("name", STAGES)
def test_no_rows(spark, name):
    out = STAGES[name](table(spark, []))
    assert out.columns == table(spark, []).columns and out.count() == 0


def test_pack_no_rows(spark):
    assert packing.pack(table(spark, [])).count() == 0


def test_exact_dedup_judges_rows(spark):
    rows = [(1, "a", "s"), (5, "a", "s"), (5, "z", "s"), (7, "q", "s"), (7, "q", "s"), (None, "a", "s"), (None, "b", None), (None, "b", None), (9, None, "s"), (8, "", "s")]
    out = exact_dedup.keep_first(table(spark, rows))
    assert out.columns == table(spark, []).columns
    assert rows_of(out) == sorted([(1, "a", "s"), (5, "z", "s"), (7, "q", "s"), (None, "b", None), (8, "", "s")], key=str)
    unique = [r for r in rows if r[0] in (1, 9, 8)] + [(4, "a", None)]
    assert rows_of(exact_dedup.keep_first(table(spark, unique))) == sorted([(1, "a", "s"), (8, "", "s")], key=str)


def test_near_dedup_judges_rows(spark):
    rows = [(3, LONG, "s"), (5, NEAR, "s"), (5, "z", "s"), (7, "q r", "s"), (7, "q r", "s"), (None, LONG, "s"), (None, NEAR + " end", None), (None, "b c", None), (9, None, "s"), (9, None, "s"), (8, "", "s")]
    out = ngram_join.keep_one(table(spark, rows))
    want = [(3, LONG, "s"), (5, "z", "s"), (7, "q r", "s"), (None, "b c", None), (9, None, "s"), (9, None, "s"), (8, "", "s")]
    assert rows_of(out) == sorted(want, key=str)
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar(table(spark, rows)).collect()), key=str)
    want = [(3, 56, 3), (5, 57, 3), (5, 1, 5), (7, 1, 7), (7, 1, 7), (None, 56, 3), (None, 58, 3), (None, 1, None), (9, 0, 9), (9, 0, 9), (8, 0, 8)]
    assert found == sorted(want, key=str)


def test_language_id_judges_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source")
    odd = spark.createDataFrame([(1, None, None, None), (1, "12 34", None, "s"), (None, "", None, "s"), (None, docs.first()["text"], None, "s")], docs.schema)
    every = docs.unionByName(odd)
    for n in NAMES.split():
        every = every.withColumn(n, F.lit(n))
    kept = language_id.keep_identified(every)
    assert kept.columns == every.columns
    clean = language_id.keep_identified(docs).count()
    assert kept.count() == clean + 1 and kept.where("doc_id is null").count() == 1
    assert kept.where("doc_id = 1").count() == docs.where("doc_id = 1").count()


def test_mixed_documents_of_any_columns(spark):
    rows = [(i, f"one two three w{i}", "ab"[i % 2]) for i in range(40)] + [(None, "x y", None), (3, "other text", "a"), (50, None, "a"), (50, None, "a"), (51, "  ", None)]
    docs = table(spark, rows)
    out = mixing.mixed_documents(docs, per_cell=5)
    assert out.columns == docs.columns
    taken = {}
    for r in mixing.mix(docs, per_cell=5).collect():
        taken.setdefault((r.doc_id, r.size), 0)
        taken[r.doc_id, r.size] += -(-r.taken // r.size) if r.size else 1
    times = {}
    for r in out.collect():
        k = r.doc_id, len((r.text or "").split())
        times[k] = times.get(k, 0) + 1
    assert times == {k: n for k, n in taken.items() if n}


def test_pack_rows_without_ids(spark):
    rows = [(None, "a b c", "s"), (None, "a b c", "s"), (1, "a b", None), (1, "c d", "t"), (2, None, "s"), (2, "", "s")]
    found = packing.pack(table(spark, rows)).collect()
    assert len(found) == 6 and sum(r.n_words for r in found) == 10
    assert len({r.bin for r in found if r.doc_id is None}) == 2  # copies are apart


def test_scopes_leave_only_what_is_kept(spark):
    where = spark._jvm.org.apache.hadoop.fs.Path(shared.scratch_dir(spark))
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    count = lambda: len(files.listStatus(where)) if files.exists(where) else 0
    before = count()
    with shared.scope(spark):
        shared.stored(spark.range(3), "gone")
        kept = shared.stored(spark.range(4), "kept", keep=True)
        with shared.scope(spark):
            shared.stored(spark.range(5), "inner", keep=True)
    assert count() == before + 1 and kept.count() == 4


def test_joined_hot_is_a_join(spark):
    many = shared.stored(spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 50).alias("k"), "id"), "many")
    one = spark.createDataFrame([(k, f"v{k}") for k in range(-1, 45)], "k long, v string")
    want = sorted(map(tuple, many.join(one, "k").collect()))
    assert sorted(map(tuple, shared.joined_hot(many, one, "k").collect())) == want
    assert sorted(map(tuple, shared.joined_hot(many, one, "k", wide=True).collect())) == want
    assert shared.joined_hot(many, one, "k", how="left").count() == 5000
