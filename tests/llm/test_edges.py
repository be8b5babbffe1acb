"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyframe.llm import (
    decontamination,
    language,
    language_model,
    minhash,
    packing,
    quality,
    queries,
    rules,
    suffix_array,
    suffix_tree,
    toxicity,
)
from tests.compare import TESTDATA

FOLDER = str(TESTDATA / "sf0.001")
COPY = " ".join(f"word{i}" for i in range(80))
LONG = " ".join(f"long{i % 997}x{i}" for i in range(60_000))
CASES = [
    (None, None),
    (None, COPY),
    (1, None),
    (2, ""),
    (3, " \t\n"),
    (4, COPY),
    (5, COPY),
    (5, COPY),
    (6, "12 ?! ..."),
    (7, LONG),
    (8, "été"),
    (8, "other words under one id"),
]
#: Columns that operators name themselves.
CLASHING = ["_fp", "_cut_text", "_kept_id", "a.b", "row", "id", "record", "score", "key", "fp", "h", "s", "n", "cid", "words", "kept", "n_words", "failed", "component", "part"]


@pytest.fixture
def cases(spark):
    df = spark.createDataFrame(CASES, "doc_id long, text string")
    return df.withColumns({c: F.lit("own") for c in CLASHING})  # quoted where they hold dots


def models():
    good, bad = "the cat sat on the mat. " * 20, "zz## qq## xx## " * 30
    return (
        language.fit([(good, "en"), ("der hund und die katze " * 20, "de")]),
        quality.fit([(good, 1), (bad, 0)] * 3),
        toxicity.fit([(good, 0)] * 6 + [(good + " you idiot.", 1)] * 6),
    )


@pytest.fixture(scope="module")
def fitted():
    return models()


def operators(df, items, fitted):
    net, convolution, noisy = fitted
    return {
        "language": language.predict(df, net),
        "tree": suffix_tree.remove_passages(df),
        "quality": quality.score_documents(df, convolution),
        "packing": packing.pack_powers_of_two(df, queries.tokenizer_path()),
        "minhash": minhash.near_duplicates(df),
        "toxicity": toxicity.score_documents(df, noisy),
        "array": suffix_array.remove_repeats(df),
        "rules": rules.apply_policy(rules.ledger(df)),
        "model": language_model.interpolated_scores(df, F.lit(0)),
        "leaks": decontamination.find_leaks(df, items),
    }


def test_every_operator_defines_the_odd_cases(spark, cases, fitted):
    items = spark.createDataFrame([(1, COPY), (None, COPY), (2, None), (3, "")], "item_id long, text string")
    found = {name: df.collect() for name, df in operators(cases, items, fitted).items()}
    for name, out in found.items():
        if name not in ("packing", "leaks"):
            assert sorted(r.doc_id or 0 for r in out) == sorted(i or 0 for i, _ in CASES), name
    assert {r.lang_pred for r in found["language"] if r.doc_id in (1, 2, 3, 6)} == {"und"}
    assert all(0 <= r.score <= 1 for name in ("language", "quality", "toxicity") for r in found[name])
    assert sorted((r.doc_id or 0, r.n_removed) for r in found["tree"] if r.n_words == 80) == [(0, 0), (4, 0), (5, 80), (5, 80)]
    copy = len(COPY)
    assert sorted((r.doc_id or 0, r.n_removed) for r in found["array"] if r.n_bytes == copy) == [
        (0, copy), (4, copy), (5, copy), (5, copy),
    ]
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in found["minhash"] if r.n_shingles == 76) == [
        (0, None, True), (4, 4, True), (5, 4, False), (5, 4, False),
    ]
    assert {(r.doc_id, r.component_id, r.kept) for r in found["minhash"] if r.doc_id in (1, 2, 3)} == {
        (i, i, True) for i in (1, 2, 3)
    }
    assert {r.doc_id for r in found["leaks"]} == {None, 4, 5}
    assert {(r.length, r.doc_tokens) for r in found["packing"] if r.doc_id in (1, 2, 3)} == {(1, 1)}
    assert {r.n_tokens for r in found["model"] if r.doc_id in (1, 2, 3)} == {1}
    assert {r.kept for r in found["rules"] if r.doc_id in (1, 2, 3)} == {False}


def test_empty_tables_give_no_rows(spark, cases, fitted):
    items = spark.createDataFrame([], "item_id long, text string")
    for name, df in operators(cases.where("false"), items, fitted).items():
        assert df.count() == 0, name
    assert decontamination.find_leaks(cases, items).count() == 0
    assert rules.ablations(rules.ledger(cases.where("false"))).where("n_failed = 0").count() == len(rules.RULES)


def test_untrained_models_score_everything(spark, cases):
    assert language.predict(cases, language.fit([])).count() == len(CASES)
    assert quality.score_documents(cases, quality.fit([])).count() == len(CASES)
    assert toxicity.score_documents(cases, toxicity.fit([])).where("score < 0.5").count() == len(CASES)


def documents_like(spark, cases):
    return cases.withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})


def test_stages_take_the_odd_cases_and_keep_the_columns(spark, cases):
    docs = documents_like(spark, cases)
    for given in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, given, FOLDER)
            assert out.dtypes == docs.dtypes, name
            out.count()


def test_stages_remove_what_they_should(spark, cases):
    docs = documents_like(spark, cases)
    stages = dict(corpus_pipeline.STAGES)
    one = stages["near_duplicates"](spark, docs, FOLDER)
    assert sorted((r.doc_id or 0) for r in one.collect()) == [0, 0, 1, 2, 3, 4, 6, 7, 8, 8]
    cut = {(r.doc_id, r.text, r.n_chars) for r in stages["substring_dedup"](spark, docs, FOLDER).collect()}
    assert 5 not in {i for i, _, _ in cut}
    assert (3, " \t\n", 3) in cut and (1, None, None) in cut


def test_ledger_and_ablations(spark, rows):
    text = {1: "good words " + COPY, 2: "too few", 3: "again and again so " * 20, 4: "HASH# TAG# " * 10 + COPY}
    book = rules.ledger(rows("doc_id long, text string", *text.items()))
    found = {r.doc_id: r.failed for r in book.collect()}
    bit = lambda name: 1 << rules.RULES.index(name)
    assert found[1] == 0 and found[2] == bit("few_words")
    assert found[3] & bit("repeated_words")
    by_rule = {r.rule: r for r in rules.ablations(book, "base").collect()}
    assert by_rule["few_words"].n_failed == 1 and by_rule["few_words"].n_only == 1
    kept = rules.apply_policy(book, "base").where("kept").count()
    assert by_rule["few_words"].kept_without == kept + 1
    assert [name for name, _ in rules._rules()] == list(rules.RULES)
