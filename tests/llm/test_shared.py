"""Written tables and the labelled sample."""

from pathlib import Path

from pyspark.sql import functions as F

from tallyframe.llm import minhash, shared, suffix_array, suffix_tree
from tallyframe.llm.text import labelled_sample


def test_release_leaves_nothing(spark, rows):
    df = rows("doc_id long, text string", *[(i, "some words " * 60) for i in range(4)])
    shared.release(spark)
    folder = Path(shared.folder(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    for operator in (minhash.near_duplicates, suffix_array.remove_repeats, suffix_tree.remove_passages):
        operator(df).count()
    assert set(folder.iterdir()) > before
    shared.release(spark)
    assert set(folder.iterdir()) == before


def test_the_sample_is_bounded_even_and_the_same(spark, rows):
    given = [(i, f"text {i}", "ab"[i % 3 == 0] if i % 10 else None) for i in range(500)]
    given += [(None, "no id", "a"), (7, None, "a"), (8, "second text of 8", "a"), (9, "rare", "c")]
    df = rows("doc_id long, text string, lang string", *given)
    labels = df.select("doc_id", "lang")
    first = labelled_sample(df, labels, "lang", 30)
    assert first == labelled_sample(df.repartition(7), labels.repartition(5), "lang", 30)
    count = {}
    for _, label in first:
        count[label] = count.get(label, 0) + 1
    assert count == {"a": 30, "b": 30, "c": 2} and ("rare", "c") in first
    assert labelled_sample(df.where("false"), labels, "lang", 30) == []
    assert labelled_sample(df, labels.where(F.lit(False)), "lang", 30) == []


def test_the_texts_are_read_once(spark, rows, tmp_path):
    path = f"file://{tmp_path}/documents"
    rows("doc_id long, text string, lang string", *[(i, f"t{i}", f"l{i % 40}") for i in range(400)]).write.parquet(path)
    df = spark.read.parquet(path)
    status = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("sample", "sample")
    assert len(labelled_sample(df, df.select("doc_id", "lang"), "lang", 5)) == 200
    jobs = len(status.getJobIdsForGroup("sample"))
    spark.sparkContext.setJobGroup("", "")
    assert jobs <= 12  # not one for each label


def test_a_written_table_frees_its_shuffle_and_puts_the_setting_back(spark, rows):
    before = spark.conf.get(shared._CLEANUP)
    grouped = rows("k long, x long", *[(i % 7, i) for i in range(100)]).groupBy("k").agg(F.sum("x").alias("x"))
    first = shared.written(grouped, "freed")
    # What made the table can be used again, and the table does not depend on it.
    again = shared.written(grouped.join(first.withColumnRenamed("x", "y"), "k"), "freed")
    assert sorted(map(tuple, again.collect())) == sorted((k, x, x) for k, x in map(tuple, grouped.collect()))
    shared.dropped(first, again)
    try:
        shared.written(grouped.select(F.raise_error(F.lit("no")).alias("x")), "freed")
    except Exception as e:
        assert "no" in str(e)
    assert spark.conf.get(shared._CLEANUP) == before
